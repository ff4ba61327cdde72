from seekwell.streaming.events import (
    read_distinct,
    read_sessions,
    read_windows,
    start_distinct,
    start_sessions,
    start_windows,
)
from seekwell.streaming.index import compact_index, read_dictionary, read_index, read_postings, start_index

__all__ = [
    "compact_index",
    "read_dictionary",
    "read_distinct",
    "read_index",
    "read_postings",
    "read_sessions",
    "read_windows",
    "start_distinct",
    "start_index",
    "start_sessions",
    "start_windows",
]
