"""The query side of a ranking: bounded blocks that are safe to broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekwell.session import durable

MAX_BLOCK_BYTES = 64 << 20


def _number(max_bytes: int):
    """The task that gives each row the number of its block: the task's own, and counted on when a block is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, used = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            numbers = []
            for size in batch.column("_size").to_pylist():
                if used and used + size > max_bytes:
                    block, used = block + 1, 0
                used += size
                numbers.append(task << 32 | block)
            yield batch.append_column("_block", pa.array(numbers, pa.int64()))

    return run


def query_blocks(queries: DataFrame, size: Column, max_bytes: int = MAX_BLOCK_BYTES) -> Iterator[pa.Table]:
    """All of `queries`, in parts of at most `max_bytes` each, or of one row where that alone is larger.

    The size is measured, not assumed. A set that fits is one block. In a larger one the tasks number their rows'
    blocks, and the set is written once; ids need not be unique. Each block is one more scan of the items.
    """
    sized = queries.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    if total <= max_bytes:
        yield queries.toArrow()
        return
    schema = T.StructType([*sized.schema.fields, T.StructField("_block", T.LongType())])
    numbered = durable(sized.mapInArrow(_number(max_bytes), schema))
    for row in numbered.select("_block").distinct().orderBy("_block").toLocalIterator():
        yield numbered.where(F.col("_block") == row[0]).select(*queries.columns).toArrow()
