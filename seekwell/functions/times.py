"""Event times as whole microseconds since 1970, whatever the session's time zone."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def micros(length: str) -> int:
    """Microseconds of "30 minutes", "1 hour" and the like."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", length.lower())
    if not found or found[2] not in UNITS or int(found[1]) == 0:
        raise ValueError(f"not a length of time: {length!r}; say a number and one of {', '.join(UNITS)}")
    return int(found[1]) * UNITS[found[2]]


def interval(us: int) -> str:
    """The length as Spark's window functions take it."""
    whole = timedelta(microseconds=us)
    return f"{whole.days} days {whole.seconds} seconds {whole.microseconds} microseconds"


def since_1970(events: DataFrame, time: str) -> Column:
    """Microseconds of a `timestamp` or `timestamp_ntz` column; the latter is read as UTC."""
    if dict(events.dtypes)[time] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    return F.unix_micros(time)


def as_instant(events: DataFrame, time: str) -> Column:
    """The column as `timestamp`, which watermarks need."""
    if dict(events.dtypes)[time] == "timestamp_ntz":
        return F.timestamp_micros(since_1970(events, time))
    return F.col(time)
