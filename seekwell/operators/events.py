"""Windows and sessions over a table of events, in one pass over the events and a small one over what is left of them.

Both rest on states that merge in any order: a pane's totals, a session's interval. So the events of a busy key can be cut
anywhere, aggregated where they lie, and put together afterwards.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.functions.times import micros, since_1970
from seekwell.operators.joins import HOT_PER_PARTITION
from seekwell.session import written

TOTAL_DIGITS = 6


def _floor(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def pane_length(size: str, slide: str) -> int:
    """The longest panes, in microseconds, that all windows are made of whole."""
    if micros(slide) > micros(size):
        raise ValueError("windows that start further apart than they are long would leave events out")
    return gcd(micros(size), micros(slide))


def panes(events: DataFrame, pane: int, by: tuple[str, ...], time: str, value: str) -> DataFrame:
    """(by, pane, n, total, least, most): totals of each stretch of `pane` microseconds; events without a time are in none."""
    timed = events.withColumn("pane", _floor(since_1970(events, time), pane)).where("pane is not null")
    return timed.groupBy(*by, "pane").agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def windows_of_panes(rows: DataFrame, size: str, slide: str, by: tuple[str, ...]) -> DataFrame:
    """(by, window_start, window_end, n, total, least, most) in microseconds: each pane goes to size / slide windows, whatever it holds."""
    length, step, pane = micros(size), micros(slide), pane_length(size, slide)
    last = _floor(F.col("pane"), step)
    first = -_floor(-(F.col("pane") + (pane - length)), step)
    return (
        rows.withColumn("window_start", F.explode(F.sequence(first, last, F.lit(step))))
        .groupBy(*by, "window_start")
        .agg(
            F.sum("n").alias("n"),
            F.round(F.sum("total"), TOTAL_DIGITS).alias("total"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
        )
        .select(*by, "window_start", (F.col("window_start") + length).alias("window_end"), "n", "total", "least", "most")
    )


def event_windows(
    events: DataFrame,
    size: str = "1 hour",
    slide: str = "15 minutes",
    by: tuple[str, ...] = ("event_type",),
    time: str = "ts",
    value: str = "value",
) -> DataFrame:
    """(by, window_start, window_end, n, total, least, most): sliding windows that hold at least one event.

    Windows are [start, end) in microseconds since 1970, starts at multiples of `slide`. An event is aggregated once, in its
    pane; panes, not events, are copied to the windows that they are part of. Null values count in n alone; a null
    key is a key; events without a time are in no window. `total` is rounded to 6 digits.
    """
    return windows_of_panes(panes(events, pane_length(size, slide), by, time, value), size, slide, by)


def _runs(rows: DataFrame, keys: list[str], start: str, end: str, length: int) -> DataFrame:
    """Intervals of a key that overlap or lie at most `length` apart, as one; (n, total) are added up."""
    ordered = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(start) - before <= length, 0).otherwise(1)
    numbered = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(
        F.min(start).alias("first"), F.max(end).alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def _dealt(events: DataFrame, keys: list[str], cut: int, by: tuple[str, ...], time: str, value: str) -> DataFrame:
    """Events as (keys, us, total, n, stretch, cut_up, piece): a stretch of a key with many events is dealt to pieces."""
    rows = events.select(
        *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)),
        since_1970(events, time).alias("us"),
        F.col(value).cast("double").alias("total"),
        F.lit(1).cast("long").alias("n"),
        F.spark_partition_id().alias("from_task"),
    ).where("us is not null")
    rows = rows.withColumn("stretch", _floor(F.col("us"), cut)).withColumn("cell", F.xxhash64(*keys, "stretch"))
    counts = written(rows.groupBy("cell").agg(F.count("*").alias("size")), "cells")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = max(1, counts.agg(F.sum("size")).first()[0] or 0)
    share = F.col("size") * (HOT_PER_PARTITION * parts)
    # at most four cells per partition can be as large as that
    busy = counts.where(share >= whole).select("cell", F.ceil(share / whole).cast("int").alias("pieces"))
    cut_up = F.coalesce(F.col("pieces") > 1, F.lit(False))
    piece = F.when(cut_up, F.pmod(F.xxhash64("us", "total", "from_task"), F.col("pieces"))).otherwise(F.lit(0))
    return rows.join(F.broadcast(busy), "cell", "left").withColumns({"cut_up": cut_up, "piece": piece}).drop("cell", "pieces", "from_task")


def event_sessions(
    events: DataFrame,
    gap: str = "30 minutes",
    by: tuple[str, ...] = ("user_id",),
    time: str = "ts",
    value: str = "value",
    stretch: str = "1 day",
) -> DataFrame:
    """(by, session_start, session_end, n, total): events of a key at most `gap` apart, in a chain, are one session.

    Times are microseconds since 1970; `session_end` is the last event's time plus the gap. Time is cut in stretches, and sessions are made
    within each stretch of a key. Those that lie further than the gap from both edges are done; the others are merged with their
    neighbours as intervals, which are few: the events of a key are never in one place. A stretch of a key that holds a quarter of
    a mean shuffle partition or more is dealt to several tasks, and all its intervals merged.

    Null values count in n alone; a null key is a key; events without a time are in no session. `total` is rounded to 6 digits.
    """
    length, cut = micros(gap), micros(stretch)
    keys = [f"key_{i}" for i in range(len(by))]
    dealt = _dealt(events, keys, cut, by, time, value)
    local = _runs(dealt.withColumn("until", F.col("us")), [*keys, "stretch", "cut_up", "piece"], "us", "until", length)
    local = written(local, "sessions")
    done = ~F.col("cut_up") & (F.col("first") - F.col("stretch") > length) & (F.col("stretch") + cut - F.col("last") > length)
    edges = local.where(~done).select(*keys, F.col("first").alias("since"), F.col("last").alias("until"), "n", "total")
    merged = _runs(edges, keys, "since", "until", length)
    columns = [*keys, "first", "last", "n", "total"]
    return local.where(done).select(*columns).unionAll(merged.select(*columns)).select(
        *(F.col(k).alias(c) for c, k in zip(by, keys)),
        F.col("first").alias("session_start"),
        (F.col("last") + length).alias("session_end"),
        "n",
        F.round("total", TOTAL_DIGITS).alias("total"),
    )
