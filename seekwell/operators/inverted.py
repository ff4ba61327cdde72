"""Inverted index and its dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.functions import term_counts, words
from seekwell.operators.joins import join_facts
from seekwell.session import durable, written


def postings(documents: DataFrame) -> DataFrame:
    """doc_id, term, tf, doc_len: counted inside each document's row, no shuffle."""
    return (
        documents.select("doc_id", term_counts(words(F.col("text"))).alias("terms"))
        # outer, because the plain form would count once more to test for empty arrays
        .select("doc_id", F.inline_outer("terms"))
        .where(F.col("term").isNotNull())
    )


def dictionary(items: DataFrame, vocab: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """term, df, total_len: document frequencies in one scan.

    The row of the empty term counts all items and their words. With `vocab`, a
    table small enough to broadcast, only its terms are counted. Map tasks count
    first, so a term that every item holds is one row per task afterwards.
    With `entries`, a stored index of just these items, those are counted in place
    of words: the same rows, and no text is read.
    """
    if entries is not None:
        return _counted(items, vocab, entries)
    terms = (
        items.select(words(F.col("text")).alias("ws"))
        .select("ws", F.size("ws").alias("len"))
        # the array always holds the empty term, so outer adds nothing; the plain form
        # would tokenize once more to test for empty arrays
        .select("len", F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("ws"))).alias("term"))
    )
    if vocab is not None:
        terms = terms.join(F.broadcast(vocab), "term", "left_semi")
    return terms.groupBy("term").agg(
        F.count("*").alias("df"),
        F.sum(F.when(F.col("term") == "", F.col("len"))).alias("total_len"),
    )


def _counted(items: DataFrame, vocab: DataFrame | None, entries: DataFrame) -> DataFrame:
    """The dictionary of `items` from their index, which has a row per item and term, and none for an item without words."""
    terms = entries.groupBy("term").agg(F.count("*").alias("df")).withColumn("total_len", F.lit(None).cast("long"))
    total = entries.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total_len"))
    whole = items.agg(F.count("*").alias("df")).where("df > 0").crossJoin(total)
    found = terms.unionByName(whole.withColumn("term", F.lit("")))
    return found if vocab is None else found.join(F.broadcast(vocab), "term", "left_semi")


def with_df(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, tf, df, doc_len: each term's df next to its entries."""
    facts = terms.where(F.col("term") != "").select("term", "df")
    return join_facts(entries, facts, "term", "df", F.col("doc_id")).select(
        "term", "doc_id", "tf", "df", "doc_len"
    )


def inverted_index(documents: DataFrame) -> DataFrame:
    """term, doc_id, tf, df, doc_len. The texts are tokenized once: postings are written, and df is counted from them."""
    entries = written(postings(documents), "postings")
    return with_df(entries, durable(entries.groupBy("term").agg(F.count("*").alias("df"))))
