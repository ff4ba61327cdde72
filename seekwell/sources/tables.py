"""Parquet inputs with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    ),
    "benchmark": T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]
    ),
    "events": T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    ),
    "embeddings": T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("label", T.IntegerType()),
        ]
    ),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the input is a few files.

    A small table in one row group is one task otherwise. An input of at least half as many files as there
    are cores has splits enough and is left as it is: its texts are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * len(df.inputFiles()) < cores else df


def stream_table(
    spark: SparkSession, folder: str, name: str, max_files_per_trigger: int = 1000
) -> DataFrame:
    """The same table as a file stream: files that arrive later are picked up.

    Takes one file or a folder of part files of just this name.
    """
    return (
        spark.readStream.schema(SCHEMAS[name])
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(f"{folder}/{name}.[p]arquet")  # a pattern, so that it may be a file
    )
