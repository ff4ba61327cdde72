"""An inverted index that grows with a stream of documents.

Each micro-batch writes three folders under its batch number: the postings of its documents, the document frequencies among
them, and their ids. A batch that is run again after a failure overwrites its own folders and nothing else. A document
that comes again, edited or not, replaces its earlier version: readers leave out the postings of versions that a later batch
has replaced, and take them off the frequencies. `compact_index` writes what is current as one table, so that
readers open two folders and not one per batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekwell.operators.inverted import dictionary, postings, with_df
from seekwell.operators.joins import join_facts
from seekwell.session import durable
from seekwell.sources import spread

POSTINGS = "doc_id long, term string, tf long, doc_len long"
TERMS = "term string, df long, total_len long"
DOCS = "doc_id long"
TABLES = {"postings": POSTINGS, "terms": TERMS, "docs": DOCS}
NOTHING = -1  # the batch number of the empty tables that a new index starts with
COMPACTED = "upto long, folder string"


def _latest_of_batch(batch: DataFrame) -> DataFrame:
    """One row per id. Where a batch holds several texts of an id there is no telling which is newer: the one whose hash is
    the largest stays, whatever order they come in. Rows without an id are documents of their own."""
    ids = batch.where("doc_id is not null").select("doc_id")
    if ids.count() == ids.distinct().count():
        return batch
    one = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.xxhash64("text"), "text")).alias("last"))
    return one.select("doc_id", "last.text").unionByName(batch.where("doc_id is null").select("doc_id", "text"))


def write_batch(root: str):
    def write(batch: DataFrame, number: int) -> None:
        rows = spread(_latest_of_batch(batch), "doc_id")
        postings(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/postings/batch={number}")
        dictionary(rows).write.mode("overwrite").parquet(f"{root}/terms/batch={number}")
        rows.select("doc_id").write.mode("overwrite").parquet(f"{root}/docs/batch={number}")

    return write


def start_index(documents: DataFrame, root: str) -> StreamingQuery:
    """Index all that `documents` (a stream) holds now, from where `root` left off; readable from the start, if no document comes."""
    for name, schema in TABLES.items():
        empty = documents.sparkSession.createDataFrame([], schema)
        empty.write.mode("overwrite").parquet(f"{root}/{name}/batch={NOTHING}")
    empty = documents.sparkSession.createDataFrame([], COMPACTED)
    empty.write.mode("overwrite").parquet(f"{root}/compacted/number={NOTHING}")
    return (
        documents.select("doc_id", "text")
        .writeStream.foreachBatch(write_batch(root))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )


def _base(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The last batch that is part of the newest compacted tables, and their folder."""
    found = spark.read.schema(COMPACTED).parquet(f"{root}/compacted").orderBy(F.desc("upto"), "folder").limit(1).collect()
    return (found[0].upto, found[0].folder) if found else (NOTHING, None)


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all batches with the number of each; compacted rows have that of the last batch they hold."""
    upto, folder = _base(spark, root)
    rows = spark.read.schema(f"{TABLES[name]}, batch long").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    rows = rows.where(F.col("batch") > upto)
    if folder is None:
        return rows
    base = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}").withColumn("batch", F.lit(upto).cast("long"))
    return base.unionByName(rows)


def _replaced(spark: SparkSession, root: str) -> DataFrame | None:
    """(doc_id, latest, n) of the documents with `n` > 1 versions, and the batch of the last; None where there are none."""
    versions = _table(spark, root, "docs").where("doc_id is not null")
    latest = versions.groupBy("doc_id").agg(F.max("batch").alias("latest"), F.count("*").alias("n")).where("n > 1")
    latest = durable(latest)
    return None if latest.isEmpty() else latest


def _current(rows: DataFrame, replaced: DataFrame | None, current: bool = True) -> DataFrame:
    """The rows of versions that are current, or of those that are not."""
    if replaced is None:
        return rows if current else rows.limit(0)
    known = join_facts(rows, replaced, "doc_id", "n", F.xxhash64(*rows.columns))
    old = F.coalesce(F.col("batch") < F.col("latest"), F.lit(False))
    return known.where(~old if current else old).select(*rows.columns)


def read_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """term, df, total_len over the current version of every document; serves as `stats` of a ranking."""
    terms = _table(spark, root, "terms").select("term", "df", "total_len")
    replaced = _replaced(spark, root)
    if replaced is not None:
        gone = _current(_table(spark, root, "postings"), replaced, current=False)
        docs = _current(_table(spark, root, "docs"), replaced, current=False)
        lengths = gone.groupBy("doc_id", "batch").agg(F.first("doc_len").alias("doc_len"))
        none = F.lit(None).cast("long")
        terms = terms.unionByName(gone.select("term", F.lit(-1).cast("long").alias("df"), none.alias("total_len")))
        terms = terms.unionByName(docs.select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("df"), none.alias("total_len")))
        terms = terms.unionByName(
            lengths.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("df"), (-F.col("doc_len")).alias("total_len"))
        )
    summed = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_len").alias("total_len"))
    return summed.where("df > 0 or term = ''")


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, term, tf, doc_len of the current version of every document."""
    return _current(_table(spark, root, "postings"), _replaced(spark, root)).select("doc_id", "term", "tf", "doc_len")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """term, doc_id, tf, df, doc_len of the current version of every document."""
    return with_df(read_postings(spark, root), durable(read_dictionary(spark, root)))


def compact_index(spark: SparkSession, root: str) -> int:
    """Write the current postings, frequencies and ids as one table each, and return the last batch that they hold.

    Readers take them from then on, with the batches that come later. To be run while no stream writes to `root`; one that fails half-way
    has changed nothing, as the note that names the new folder is written last. Folders that are no longer read stay until they are removed.
    """
    upto = _table(spark, root, "docs").agg(F.max("batch")).first()[0]
    if upto is None or upto == NOTHING:
        return NOTHING
    folder = f"{root}/base/{uuid.uuid4()}"
    read_postings(spark, root).write.option("compression", "zstd").parquet(f"{folder}/postings")
    read_dictionary(spark, root).write.parquet(f"{folder}/terms")
    ids = _current(_table(spark, root, "docs"), _replaced(spark, root)).select("doc_id")
    ids.write.parquet(f"{folder}/docs")
    note = spark.createDataFrame([(upto, folder)], COMPACTED)
    note.coalesce(1).write.mode("overwrite").parquet(f"{root}/compacted/number={upto}")
    return upto
