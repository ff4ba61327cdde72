"""Ranking of texts by their words: BM25 and TF-IDF top lists, fusion, packing.

One scan scores every item against a broadcast block of queries inside its task
and keeps the best per query; only those leave the task. No (query, item) pair
is shuffled, so a word that every item holds costs nothing but arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekwell.functions import norm, words
from seekwell.operators.best import merge_best
from seekwell.operators.chunks import chunk_documents
from seekwell.operators.inverted import dictionary
from seekwell.operators.queries import MAX_BLOCK_BYTES, query_blocks
from seekwell.operators.scores import BM25, TFIDF, QueryBlock, scan_better, scan_entries, scan_texts

FOUND = [
    T.StructField("score", T.DoubleType()),
    T.StructField("query", T.LongType()),
    T.StructField("method", T.StringType()),
]


def _blocks(
    queries: DataFrame,
    count: Callable[[DataFrame], DataFrame],
    k1: float,
    b: float,
    max_block_bytes: int,
    row_bytes: int = 0,
) -> Iterator[tuple[Broadcast, DataFrame]]:
    """Broadcast blocks of queries with their weights, and the vocabulary of each (term, number in the block).

    `count` gives the dictionary rows of a vocabulary, which is no larger than
    its block; the empty term is in it. `row_bytes` is what else a query will take in its block.
    """
    spark = queries.sparkSession
    tokenized = queries.select(F.col("query").cast("long").alias("query"), words(F.col("text")).alias("ws"))
    size = F.octet_length(F.array_join("ws", " ")).cast("long") + 16 + row_bytes
    for table in query_blocks(tokenized, size, max_block_bytes):
        block = QueryBlock.of(table)
        if block.vocab:
            numbers = pa.array(range(-1, len(block.vocab)), pa.int32())
            vocab = spark.createDataFrame(pa.table({"term": pa.array(["", *block.vocab], pa.string()), "number": numbers}))
            known = {r["term"]: (r["df"], r["total_len"]) for r in count(vocab).collect()}
            # plain values, which executors can read without this package
            yield spark.sparkContext.broadcast(vars(block.weighed(known, k1, b))), vocab


def _stored(stats: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda vocab: stats.join(F.broadcast(vocab), "term", "left_semi")


def _merged(
    found: list[DataFrame], schema: T.StructType, spark: SparkSession, ids: list[str], budget: int
) -> DataFrame:
    found = found or [spark.createDataFrame([], schema)]
    return merge_best(reduce(DataFrame.unionByName, found), ["query", "method"], ids, budget)


def rank_texts(
    queries: DataFrame,
    items: DataFrame,
    ids: list[str],
    budget: int,
    methods: tuple[str, ...] = (BM25,),
    cost: str | None = None,
    carry: tuple[str, ...] = (),
    k1: float = 1.2,
    b: float = 0.75,
    stats: DataFrame | None = None,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Best `items` (ids..., text, ...) for every one of `queries` (query, text).

    Returns query, method, rank, ids..., score, cost, used, carry... A row costs
    1, or the value of `cost`; see `best` for the budget rule. `stats` is a stored
    `dictionary` of the items; without it, it takes one more scan of them.
    """
    cost_col = F.lit(1) if cost is None else F.col(cost)
    scanned = items.select(
        *ids, *carry, cost_col.cast("long").alias("cost"), norm(F.col("text")).alias("norm")
    )
    schema = T.StructType([f for f in scanned.schema.fields if f.name != "norm"] + FOUND)
    count = _stored(stats) if stats is not None else lambda vocab: dictionary(items, vocab)
    found = [
        scanned.mapInArrow(scan_texts(block, list(methods), ids, budget), schema)
        for block, _ in _blocks(queries, count, k1, b, max_block_bytes)
    ]
    best = _merged(found, schema, items.sparkSession, ids, budget)
    return best.select("query", "method", "rank", *ids, "score", "cost", "used", *carry)


def rank_index(
    queries: DataFrame,
    entries: DataFrame,
    stats: DataFrame,
    k: int = 10,
    methods: tuple[str, ...] = (BM25,),
    k1: float = 1.2,
    b: float = 0.75,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """The same ranking from a stored index and its dictionary; no text is read.

    Only entries of the queries' terms are shuffled, once, by document, so that
    no term gathers them, and with the term's number in the block for the term:
    query, method, rank, doc_id, score.
    """
    ids = [T.StructField("doc_id", T.LongType()), T.StructField("cost", T.LongType())]
    schema = T.StructType(ids + FOUND)
    found = []
    for block, vocab in _blocks(queries, _stored(stats), k1, b, max_block_bytes):
        wanted = (
            entries.select("doc_id", "term", "tf", "doc_len")
            .join(F.broadcast(vocab), "term")
            .repartition("doc_id")
            .sortWithinPartitions("doc_id")
            .select("doc_id", "number", "tf", "doc_len")
        )
        found.append(wanted.mapInArrow(scan_entries(block, list(methods), k), schema))
    best = _merged(found, schema, entries.sparkSession, ["doc_id"], k)
    return best.select("query", "method", "rank", "doc_id", "score")


def bm25_topk(queries: DataFrame, documents: DataFrame, k: int = 10, **options) -> DataFrame:
    """query, rank, doc_id, score: the k best documents of every query."""
    return rank_texts(queries, documents, ["doc_id"], k, **options).select(
        "query", "rank", "doc_id", "score"
    )


def rank_fusion(
    queries: DataFrame,
    documents: DataFrame,
    k: int = 10,
    damping: int = 60,
    k1: float = 1.2,
    b: float = 0.75,
    stats: DataFrame | None = None,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Reciprocal-rank fusion of the whole BM25 and TF-IDF rankings: sum of 1 / (damping + rank), the best k.

    Exact without either ranking whole. A document behind the first L of both has at most 2 / (damping + L + 1), and the
    first k of one have at least 1 / (damping + k): with L = damping + 2k all winners are among the first L of one
    list. One scan finds those, with their scores in both lists; a second counts who is ahead of each, which is its rank.
    What leaves a task is 2L rows per query and list at most, whatever the corpus.
    """
    spark, methods, depth = documents.sparkSession, [BM25, TFIDF], damping + 2 * k
    scanned = documents.select("doc_id", F.lit(1).cast("long").alias("cost"), norm(F.col("text")).alias("norm"))
    count = _stored(stats) if stats is not None else lambda vocab: dictionary(documents, vocab)
    kept = [f for f in scanned.schema.fields if f.name != "norm"]
    schema = T.StructType([*kept, *FOUND[:1], T.StructField("other", T.DoubleType()), *FOUND[1:]])
    ranked = []
    for block, _ in _blocks(queries, count, k1, b, max_block_bytes, row_bytes=4 * depth * 32):
        found = scanned.mapInArrow(scan_texts(block, methods, ["doc_id"], depth, other=True), schema)
        first = merge_best(found, ["query", "method"], ["doc_id"], depth)
        score = {m: F.max(F.when(F.col("method") == m, F.col("score")).otherwise(F.col("other"))).alias(m) for m in methods}
        both = first.groupBy("query", "doc_id").agg(*score.values()).toArrow()  # counted in the block's size
        marks, table = _marks(block.value["ids"], both, methods)
        shared = spark.sparkContext.broadcast(marks)
        better = scanned.mapInArrow(scan_better(block, shared, methods), "slot long, better long")
        better = better.groupBy("slot").agg(F.sum("better").alias("better"))
        place = F.coalesce("better", F.lit(0)) + 1
        ranked.append(spark.createDataFrame(table).join(better, "slot", "left").select("query", "doc_id", place.alias("place")))
    if not ranked:
        ranked = [spark.createDataFrame([], "query long, doc_id long, place long")]
    fused = (
        reduce(DataFrame.unionByName, ranked)
        .groupBy("query", "doc_id")
        .agg(
            F.round(F.sum(1.0 / (F.lit(damping) + F.col("place"))), 9).alias("score"),
            F.count("*").alias("n_lists"),
        )
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return (
        fused.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= k)
        .select("query", "rank", "doc_id", "score", "n_lists")
    )


def _marks(ids: np.ndarray, both: pa.Table, methods: list[str]) -> tuple[tuple[np.ndarray, ...], pa.Table]:
    """(code, score, doc_id) of each row in each list, sorted by code, and a table of their slots."""
    query, doc_id = both["query"].to_numpy(), both["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    at = order[np.searchsorted(ids, query, sorter=order)] if len(query) else np.zeros(0, dtype=np.int64)
    code = np.concatenate([at + i * len(ids) for i in range(len(methods))])
    score = np.concatenate([both[m].to_numpy() for m in methods])
    doc_id, query = np.tile(doc_id, len(methods)), np.tile(query, len(methods))
    matched = np.isfinite(score)
    by_code = np.flatnonzero(matched)[np.argsort(code[matched], kind="stable")]
    marks = (code[by_code], score[by_code], doc_id[by_code])
    slots = pa.table({"slot": np.arange(len(by_code)), "query": query[by_code], "doc_id": doc_id[by_code]})
    return marks, slots


def context_pack(
    queries: DataFrame,
    documents: DataFrame,
    budget: int = 256,
    width: int = 64,
    stride: int = 48,
    **options,
) -> DataFrame:
    """The best chunks of every query, in rank order, while they fit `budget` words.

    Packing stops at the first chunk that does not fit.
    """
    chunks = chunk_documents(documents, width, stride)
    packed = rank_texts(
        queries, chunks, ["doc_id", "chunk"], budget, cost="n_words", carry=("text",), **options
    )
    return packed.select(
        "query",
        "rank",
        "doc_id",
        "chunk",
        "score",
        F.col("cost").alias("n_words"),
        F.col("used").alias("words_used"),
        "text",
    )
