"""A training corpus from `documents`: quality filter, exact and near duplicates, repeated strings, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.llm.common import temporary, written
from seekwell.llm.exact_dedup import exact_copies
from seekwell.llm.near_texts import near_text_components, text_nodes
from seekwell.llm.packing import cut_pieces, pack
from seekwell.llm.quality import fit, quality
from seekwell.llm.queries import CONTEXT, END_ID, KEEP_SCORE, REPEAT, labels
from seekwell.llm.simhash import near_components, simhash
from seekwell.llm.suffix_dedup import remove_repeats, whole_characters
from seekwell.sources import read_table


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is among `ids`, and those without an id, which no decision can name. Rows that share an
    id stay or go together."""
    named = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_semi")
    return named.select(*docs.columns).unionAll(docs.where("doc_id is null"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; an empty text has no words to reject it by but the bias."""
    score = _free(docs, "score")
    scored = quality(docs, fit(docs, labels(spark, sf_dir)), out=score)
    return scored.where(F.col(score) >= KEEP_SCORE).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then that of the smallest id."""
    return _only(docs, exact_copies(docs).where("kept and doc_id is not null"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest id. Two kinds of links count, chains of both included: those of
    op4, SimHash fingerprints of three-word shingles that differ in at most 2 of 64 bits, and resemblances of 0.8 or more of
    five-word shingles, verified on the whole sets, whose candidates agree in bands of wide fingerprints and are near in their first bits."""
    with temporary(spark):
        prints = written(simhash(text_nodes(docs)).select("node", "fingerprint"), "simhash")
        alike = near_components(prints, doc_id="node").where("node <> component_id")
        found = near_text_components(docs, links=alike.select(F.col("node").alias("a"), F.col("component_id").alias("b")))
    return _only(docs, found.where("doc_id = component_id"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that occurred before. A document that loses all its text stays, with an empty one."""
    others = {f"other_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(name) for name, c in others.items()))
    # written in between: two Python steps in one stage take two workers a task, which stay beside those of the stages that follow
    left = written(remove_repeats(plain, REPEAT, others=tuple(others)).select("doc_id", "kept", *others), "cut")
    left = left.withColumn("text", whole_characters(F.col("kept")))
    found = left.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *others)
    return found.withColumnsRenamed(others).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of `CONTEXT` tokens."""
    pieces = cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CONTEXT, END_ID)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(pieces, CONTEXT).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # no SQL can train the classifier or hash the fingerprints
