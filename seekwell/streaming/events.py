"""Events as a stream: repeats dropped, sliding windows and sessions kept up to date, across restarts.

What has to be remembered is in Spark's state store under `root`, next to the progress of the stream; a query that
is started again goes on from there. Each micro-batch writes a folder of its own under its number, so one that is run again
after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from seekwell.functions.times import as_instant, interval, micros
from seekwell.operators.events import TOTAL_DIGITS, pane_length, windows_of_panes

DELAY = "1 hour"


def _start(rows: DataFrame, root: str, mode: str) -> StreamingQuery:
    """Write what `rows` emits, a folder per micro-batch; a first empty one makes a stream without rows readable."""
    spark, schema = rows.sparkSession, rows.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/rows/micro_batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/micro_batch={number}")

    return (
        rows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )


def _read(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(f"{root}/rows")


def _once_per_batch(key: str):
    """Of the rows of an Arrow batch that share a key, the first: a key that is sent over and over is few rows to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.table({"key": batch.column(key), "place": pa.array(np.arange(batch.num_rows))})
                first = rows.group_by("key").aggregate([("place", "min")])["place_min"]
                yield batch.take(pa.array(np.sort(first.to_numpy())))

    return run


def start_distinct(events: DataFrame, root: str, key: str = "event_id", time: str = "ts", delay: str = DELAY) -> StreamingQuery:
    """Write the first arrival of each `key` of the stream `events`.

    A key is remembered until the watermark, which is the latest time met so far less `delay`, has passed the time of its first arrival by
    `delay`; repeats until then are dropped, and later ones are new. Events older than the watermark, and those without a time,
    are too late to be judged and are dropped, as are those from before 1970. A null key is a key. State is bounded by the keys of two delays.
    """
    timed = events.mapInArrow(_once_per_batch(key), events.schema).withColumn("event_time", as_instant(events, time))
    timed = timed.where("event_time is not null").withWatermark("event_time", interval(micros(delay)))
    return _start(timed.dropDuplicatesWithinWatermark([key]).drop("event_time"), root, "append")


def read_distinct(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The events written so far; `schema` is that of the events."""
    return _read(spark, root, schema).drop("micro_batch")


def start_windows(
    events: DataFrame,
    root: str,
    size: str = "1 hour",
    slide: str = "15 minutes",
    by: tuple[str, ...] = ("event_type",),
    time: str = "ts",
    value: str = "value",
    delay: str = DELAY,
) -> StreamingQuery:
    """Keep the panes of sliding windows up to date: each micro-batch writes the panes that it changed, whole.

    State is a row per key and pane that the watermark has not passed, not one per window.
    """
    pane = interval(pane_length(size, slide))
    timed = events.withColumn("event_time", as_instant(events, time)).where("event_time is not null")
    rows = (
        timed.withWatermark("event_time", interval(micros(delay)))
        .groupBy(F.window("event_time", pane), *by)
        .agg(
            F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
            F.max("event_time").alias("latest"),
        )
        .select(*by, F.unix_micros("window.start").alias("pane"), "n", "total", "least", "most", F.unix_micros("latest").alias("latest"))
    )
    return _start(rows, root, "update")


def read_windows(
    spark: SparkSession, root: str, by: str = "event_type string", size: str = "1 hour", slide: str = "15 minutes", delay: str = DELAY
) -> DataFrame:
    """(by, window_start, window_end, n, total, least, most) of the windows that are closed: those that end by the watermark.

    `by` is the schema of the keys. Of a pane that several micro-batches wrote the last version counts.
    """
    names = tuple(c.strip().split()[0] for c in by.split(","))
    rows = _read(spark, root, f"{by}, pane long, n long, total double, least double, most double, latest long, micro_batch long")
    found = F.max_by(F.struct("n", "total", "least", "most"), "micro_batch").alias("last")
    panes = rows.groupBy(*names, "pane").agg(found).select(*names, "pane", "last.*")
    mark = (rows.agg(F.max("latest")).first()[0] or 0) - micros(delay)
    return windows_of_panes(panes, size, slide, names).where(F.col("window_end") <= mark)


def start_sessions(
    events: DataFrame,
    root: str,
    gap: str = "30 minutes",
    by: tuple[str, ...] = ("user_id",),
    time: str = "ts",
    value: str = "value",
    delay: str = DELAY,
) -> StreamingQuery:
    """Write each session once the watermark has passed its end; open ones stay in the state as intervals, which merge."""
    timed = events.withColumn("event_time", as_instant(events, time)).where("event_time is not null")
    rows = (
        timed.withWatermark("event_time", interval(micros(delay)))
        .groupBy(F.session_window("event_time", interval(micros(gap))).alias("session"), *by)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(
            *by,
            F.unix_micros("session.start").alias("session_start"),
            F.unix_micros("session.end").alias("session_end"),
            "n",
            F.round("total", TOTAL_DIGITS).alias("total"),
        )
    )
    return _start(rows, root, "append")


def read_sessions(spark: SparkSession, root: str, by: str = "user_id long") -> DataFrame:
    """(by, session_start, session_end, n, total) of the sessions that are closed; `by` is the schema of the keys."""
    rows = _read(spark, root, f"{by}, session_start long, session_end long, n long, total double")
    return rows.drop("micro_batch")
