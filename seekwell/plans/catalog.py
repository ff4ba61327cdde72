"""The registered queries: each runs an operator over whole tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell import operators as op
from seekwell.functions.times import since_1970
from seekwell.plans.parameters import BANDS, BITS, JOIN_COSINE
from seekwell.session import shared_dir, written
from seekwell.sources import SCHEMAS, read_table, spread, stream_table
from seekwell.streaming import (
    read_distinct,
    read_index,
    read_sessions,
    read_windows,
    start_distinct,
    start_index,
    start_sessions,
    start_windows,
)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), "text")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return op.chunk_documents(_documents(spark, folder))


def inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    return op.inverted_index(_documents(spark, folder))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return op.bm25_topk(_questions(spark, folder), _documents(spark, folder))


def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return op.rank_fusion(_questions(spark, folder), _documents(spark, folder))


def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    return op.context_pack(_questions(spark, folder), _documents(spark, folder))


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    return op.knn_topk(vectors, vectors)


def knn_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return op.knn_lsh(_vectors(spark, folder), bits=BITS, bands=BANDS)


def vector_join(spark: SparkSession, folder: str) -> DataFrame:
    return op.vector_join(_vectors(spark, folder), JOIN_COSINE)


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    root = f"{shared_dir(spark)}/index-{uuid.uuid4()}"
    start_index(stream_table(spark, folder, "documents"), root).awaitTermination()
    return read_index(spark, root)


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return op.dictionary(_documents(spark, folder)).withColumn("total_len", F.coalesce("total_len", F.lit(0)))


def rank_index(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 from a stored index and its dictionary, which are written first. Texts are tokenized once, for the index."""
    docs = _documents(spark, folder)
    entries = written(op.inverted_index(docs), "index")
    terms = written(op.dictionary(docs, entries=entries), "terms")
    return op.rank_index(_questions(spark, folder), entries, terms).select("query", "rank", "doc_id", "score")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def _new_root(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4()}"


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return op.event_windows(_events(spark, folder))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return op.event_sessions(_events(spark, folder))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a source that delivers each of them twice; times in microseconds since 1970."""
    root, events = _new_root(spark, "distinct"), SCHEMAS["events"]
    twice = stream_table(spark, folder, "events").unionAll(stream_table(spark, folder, "events"))
    start_distinct(twice, root).awaitTermination()
    found = read_distinct(spark, root, events)
    return found.withColumn("ts", since_1970(found, "ts"))


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    root = _new_root(spark, "windows")
    start_windows(stream_table(spark, folder, "events"), root).awaitTermination()
    return read_windows(spark, root)


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    root = _new_root(spark, "sessions")
    start_sessions(stream_table(spark, folder, "events"), root).awaitTermination()
    return read_sessions(spark, root)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chunk_documents,
        inverted_index,
        bm25_topk,
        rank_fusion,
        context_pack,
        knn_topk,
        knn_lsh,
        vector_join,
        stream_ingest,
        dictionary,
        rank_index,
        event_windows,
        event_sessions,
        stream_dedup,
        stream_windows,
        stream_sessions,
    )
}
