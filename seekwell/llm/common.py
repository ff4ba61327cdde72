"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.session import shared_dir
from seekwell.sources import read_table

T = TypeVar("T")
_STATE = "_seekwell_worker_state"


def worker_state(key: tuple[str, ...], make: Callable[[], T]) -> T:
    """What `make` builds, once per Python worker.

    Task code arrives pickled by value, so its own globals last for one task; a
    module of the interpreter lasts as long as the worker. Nothing in it is needed
    for right results: a worker that starts anew builds it again. The first word of a key
    names an operator, and a worker keeps the state of one operator only.
    """
    kept = sys.modules.setdefault(_STATE, types.ModuleType(_STATE)).__dict__
    for other in [k for k in kept if isinstance(k, tuple) and k[0] != key[0]]:
        del kept[other]
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Returns memory that this process has freed, and its allocators have kept, to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task, after which the worker gives memory back: workers outlive their tasks, and idle ones count beside those at work."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id` and whole text of every document; a null text is empty."""
    return read_table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def small(batches: Iterator[pa.Array], rows: int = 1024) -> Iterator[pa.Array]:
    """The same rows in smaller columns, so that what is made of them at once is small too."""
    for column in batches:
        for start in range(0, len(column), rows):
            yield column.slice(start, rows)


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under the folder that driver and executors share."""
    import uuid

    return f"{shared_dir(spark)}/{what}-{uuid.uuid4()}"


# the tables written in the innermost `temporary` block of this thread
_TEMPORARY: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("temporary", default=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage is cut, a lost executor costs a re-read."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (tables := _TEMPORARY.get()) is not None:
        tables.append((table, path))
    return table


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are `written` inside the block are removed at its end, also after a failure, but for those handed to `keep`.

    What leaves the block must not read any other of them.
    """
    tables: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    outer = _TEMPORARY.set(tables)
    try:
        yield keep
    finally:
        _TEMPORARY.reset(outer)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for table, name in tables:
            if not any(table is k for k in kept):
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def file_system(uri: str):
    """The pyarrow file system of a folder name, and its path there. For files that tasks write or read themselves."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
