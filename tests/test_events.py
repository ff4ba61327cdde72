"""Windows, sessions and repeats of events: batch, stream and plain Python."""

import random
import shutil
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seekwell.functions.times import micros
from seekwell.operators import event_sessions, event_windows
from seekwell.operators.events import _dealt
from seekwell.session import shared_dir
from seekwell.sources import SCHEMAS, stream_table
from seekwell.streaming import (
    read_distinct,
    read_sessions,
    read_windows,
    start_distinct,
    start_sessions,
    start_windows,
)

MINUTE = 60_000_000
HOUR = 60 * MINUTE
FIELDS = "event_id long, us long, user_id long, event_type string, value double, props string"


def events(spark, data):
    """Events of (event_id, microseconds or None, user_id, event_type, value)."""
    rows = spark.createDataFrame([(*r, "{}") for r in data], FIELDS)
    ts = F.expr("timestampadd(MICROSECOND, us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return rows.withColumn("ts", ts).select(*SCHEMAS["events"].names)


def made(n=900, seed=1, days=3):
    """A third of all events are user 0's, half of those within two hours; ties, nulls and gaps of just the limit."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rng.choice([None, 1, 2, 3, *range(10, 60)])
        us = rng.randrange(2 * HOUR) if i % 6 == 0 else rng.randrange(days * 24 * HOUR)
        out.append((i, us, user, rng.choice(["a", "b", None]), None if i % 50 == 0 else round(rng.random() * 9, 2)))
    out += [(n, 30 * MINUTE * k, 7, "tie", 1.0) for k in range(200)]  # one session over four days, 30 minutes apart
    out += [(n, 31 * MINUTE * k, 8, "tie", 1.0) for k in range(200)] + [(n, 5, 9, "copy", 2.0)] * 300
    out += [(n + 1, None, 7, "a", 1.0), (n + 2, -5 * MINUTE, 7, "a", 1.0), (n + 3, 24 * HOUR, 99, "a", None)]
    return out


def plain_sessions(data, gap):
    by_user = defaultdict(list)
    for _, us, user, _, value in data:
        if us is not None:
            by_user[user].append((us, value))
    out = []
    for user, rows in by_user.items():
        rows.sort(key=lambda r: r[0])
        run = [rows[0]]
        for row in [*rows[1:], None]:
            if row is None or row[0] - run[-1][0] > gap:
                values = [v for _, v in run if v is not None]
                out.append((user, run[0][0], run[-1][0] + gap, len(run), round(sum(values), 6) if values else None))
                run = []
            run.append(row)
    return sorted(out, key=repr)


def plain_windows(data, size, slide):
    found = defaultdict(list)
    for _, us, _, kind, value in data:
        if us is not None:
            start = us // slide * slide
            while start > us - size:
                found[kind, start].append(value)
                start -= slide
    out = []
    for (kind, start), values in found.items():
        known = [v for v in values if v is not None]
        ends = (round(sum(known), 6), min(known), max(known)) if known else (None, None, None)
        out.append((kind, start, start + size, len(values), *ends))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize(("gap", "stretch"), [("30 minutes", "1 day"), ("30 minutes", "1 hour"), ("2 hours", "1 day"), ("1 second", "90 minutes")])
def test_sessions(spark, gap, stretch, parts):
    data = made()
    frame = events(spark, data).repartition(parts).withColumns({"n": F.lit("own"), "key_0": F.lit(0), "run": F.lit(1)})
    got = event_sessions(frame, gap, stretch=stretch)
    assert got.columns == ["user_id", "session_start", "session_end", "n", "total"]
    assert rows(got) == plain_sessions(data, micros(gap))


def test_a_busy_user_is_spread(spark):
    data = [(i, i % 5000, 0, "a", 1.0) for i in range(6000)] + [(i, i * HOUR, i, "b", 1.0) for i in range(3000)]
    dealt = _dealt(events(spark, data), ["key_0"], micros("1 day"), ("user_id",), "ts", "value")
    most = dealt.groupBy("key_0", "stretch", "piece").count().agg(F.max("count")).first()[0]
    assert most < 6000 / 8
    found = event_sessions(events(spark, data)).where("user_id = 0").collect()
    assert [(r.session_start, r.n) for r in found][0][0] == 0 and sum(r.n for r in found) == 6001


@pytest.mark.parametrize(("size", "slide"), [("1 hour", "15 minutes"), ("1 hour", "1 hour"), ("1 hour", "25 minutes"), ("1 day", "7 hours")])
def test_windows(spark, size, slide):
    data = made()
    got = event_windows(events(spark, data).repartition(4).withColumn("pane", F.lit(1)), size, slide)
    assert rows(got) == plain_windows(data, micros(size), micros(slide))


def test_no_events(spark):
    none = events(spark, [])
    assert event_sessions(none).count() == event_windows(none).count() == 0


def test_lengths(spark):
    assert micros("90 seconds") == 90_000_000 and micros(" 1 day ") == 24 * HOUR
    for wrong in ("", "0 hours", "hour", "1 fortnight", "-1 hour"):
        with pytest.raises(ValueError, match="length of time"):
            micros(wrong)
    with pytest.raises(ValueError, match="leave events out"):
        event_windows(events(spark, []), "1 hour", "2 hours")


class Arrivals:
    """A table of events that grows by a file at a time, and a stream over it."""

    def __init__(self, spark, tmp_path):
        self.spark, self.tmp_path, self.n = spark, tmp_path, 0
        self.root = f"{shared_dir(spark)}/events-{uuid.uuid4()}"
        (tmp_path / "in" / "events.parquet").mkdir(parents=True)

    def add(self, data):
        name = f"part{self.n}"
        self.n += 1
        events(self.spark, data).coalesce(1).write.parquet(str(self.tmp_path / name))
        for f in (self.tmp_path / name).glob("*.parquet"):
            shutil.copy(f, self.tmp_path / "in" / "events.parquet" / f"{name}.parquet")

    def run(self, start, **how):
        start(stream_table(self.spark, str(self.tmp_path / "in"), "events", 1), self.root, **how).awaitTermination()


def test_repeats_across_restarts(spark, tmp_path):
    stream = Arrivals(spark, tmp_path)
    first = [(i, HOUR + i * MINUTE, 1, "a", 1.0) for i in range(60)]
    stream.add(first + first[:10] + [(0, HOUR + 3, 1, "a", 1.0)] * 500)  # repeats in a batch
    stream.run(start_distinct)
    ids = lambda: sorted(r.event_id for r in read_distinct(spark, stream.root, SCHEMAS["events"]).collect())
    assert ids() == list(range(60))
    stream.add([(59, 119 * MINUTE, 1, "a", 1.0), (30, 90 * MINUTE, 1, "a", 1.0), (60, 2 * HOUR, 1, "a", 1.0), (None, 2 * HOUR, 1, "a", 1.0)])
    stream.run(start_distinct)  # repeats after a restart, inside the watermark
    assert ids_without_null(spark, stream) == list(range(61))
    stream.add([(61, 9 * HOUR, 1, "a", 1.0), (62, None, 1, "a", 1.0)])  # the watermark moves to 8 h; an event without a time
    stream.run(start_distinct)
    stream.add([(5, 9 * HOUR, 1, "a", 2.0), (63, 10 * HOUR, 1, "a", 1.0), (64, 2 * HOUR, 1, "a", 1.0), (61, 9 * HOUR, 1, "a", 1.0)])
    stream.run(start_distinct)  # 5 is forgotten and new, 64 is too late, 61 is known
    assert ids_without_null(spark, stream) == sorted([*range(62), 5, 63])
    stream.run(start_distinct)  # nothing has come
    assert ids_without_null(spark, stream) == sorted([*range(62), 5, 63])


def ids_without_null(spark, stream):
    found = [r.event_id for r in read_distinct(spark, stream.root, SCHEMAS["events"]).collect()]
    assert found.count(None) == 1
    return sorted(i for i in found if i is not None)


def in_three(data, late=50 * MINUTE):
    """Three files in order of time, some events in a later file than their time says, by less than the delay."""
    timed = sorted((r for r in data if r[1] is not None and r[1] >= 0), key=lambda r: r[1])
    rng = random.Random(7)
    arrival = sorted(timed, key=lambda r: r[1] + (rng.randrange(late) if rng.random() < 0.2 else 0))
    third = len(arrival) // 3
    return timed, [arrival[:third], arrival[third : 2 * third], arrival[2 * third :]]


def test_streams_equal_the_batch_on_what_is_closed(spark, tmp_path):
    timed, files = in_three(made(seed=5) + [(5000, 5 * 24 * HOUR, 1, "a", 1.0)])
    mark = max(r[1] for r in timed) - HOUR
    closed = {
        "windows": [r for r in plain_windows(timed, HOUR, 15 * MINUTE) if r[2] <= mark],
        "sessions": [r for r in plain_sessions(timed, 30 * MINUTE) if r[2] <= mark],
    }
    assert all(len(v) > 20 for v in closed.values())
    for name, start, read in [("windows", start_windows, read_windows), ("sessions", start_sessions, read_sessions)]:
        (tmp_path / name).mkdir()
        stream = Arrivals(spark, tmp_path / name)
        for file in files:  # a restart after each
            stream.add(file)
            stream.run(start)
        assert rows(read(spark, stream.root)) == closed[name]
        seen = rows(read(spark, stream.root))
        stream.run(start)
        assert rows(read(spark, stream.root)) == seen


def test_streams_of_nothing(spark, tmp_path):
    for name, start in [("d", start_distinct), ("w", start_windows), ("s", start_sessions)]:
        (tmp_path / name).mkdir()
        stream = Arrivals(spark, tmp_path / name)
        stream.add([])
        stream.run(start)
        read = {"d": lambda: read_distinct(spark, stream.root, SCHEMAS["events"]), "w": lambda: read_windows(spark, stream.root), "s": lambda: read_sessions(spark, stream.root)}
        assert read[name]().count() == 0
