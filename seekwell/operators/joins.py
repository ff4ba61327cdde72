"""Equi-join of many rows with one fact per key, when a key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_PER_PARTITION = 4
LANES = 1 << 20
MAX_HOT_BYTES = 64 << 20


def _bytes(column: Column, kind: T.DataType) -> Column | None:
    """About how many bytes a value of varying size takes; None for a kind of fixed size."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.coalesce(F.size(column) * 8, F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return None


def _join_in_lanes(rows: DataFrame, facts: DataFrame, key: str, names: list[str], spread_by: Column) -> DataFrame:
    """The join with copies of the facts of hot keys, those with a number of `lanes`."""
    by_key = F.pmod(F.xxhash64(key), F.lit(LANES))
    own = F.when(F.col("lanes").isNull(), F.array(by_key)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("lanes", F.lit(1)) - 1), lambda i: i + LANES)
    )
    dealt = facts.select(key, F.struct(*names).alias("facts"), F.explode(own).alias("lane"))
    hot = facts.where("lanes is not null").select(key, "lanes")
    lane = F.when(F.col("lanes").isNull(), by_key).otherwise(LANES + F.pmod(F.xxhash64(spread_by), F.col("lanes")))
    return (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("lane", lane)
        .join(dealt, [key, "lane"], "left")
        .select(*rows.columns, *[F.col("facts")[n].alias(n) for n in names])
    )


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, spread_by: Column) -> DataFrame:
    """`rows` with the columns of `facts`, which has at most one row per `key`; null where none.

    `facts[weight]` is the number of rows that hold the key. `facts` is read
    three times, so it should come from a written table.

    A key with at least a quarter of the rows of a mean shuffle partition is hot. There are at
    most four of those per partition, whatever the data, so they are broadcast. The other keys are
    joined by a shuffle in which none outweighs a quarter of a partition.
    Rows of hot keys have their facts by then: they go along in the same pass,
    spread over all tasks by `spread_by`, and match nothing.

    Facts that vary in size are measured first. Hot ones of more than `MAX_HOT_BYTES` in all are not broadcast: of each
    a copy is shuffled to as many lanes as its rows fill quarter partitions, and only the number of lanes is broadcast.
    """
    sizes = [s for f in facts.schema if (s := _bytes(F.col(f.name), f.dataType)) is not None]
    total = facts.agg(F.sum(weight)).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(weight) * (HOT_PER_PARTITION * parts) >= total
    names = [c for c in facts.columns if c != key]
    hot = facts.where(is_hot).select(key, F.struct(*names).alias("hot"))
    if sizes and (facts.where(is_hot).agg(F.sum(reduce(add, sizes))).first()[0] or 0) > MAX_HOT_BYTES:
        lanes = F.ceil(F.col(weight) * (HOT_PER_PARTITION * parts) / max(1, total)).cast("long")
        return _join_in_lanes(rows, facts.withColumn("lanes", F.when(is_hot, lanes)), key, names, spread_by)
    # lanes 0 .. LANES - 1 go by the key, and the lanes behind them hold no facts; a constant
    # in their place would be folded into a filter, and the shuffle would go by the key alone
    by_key = F.pmod(F.xxhash64(key), F.lit(LANES))
    cold = facts.where(~is_hot).select(key, F.struct(*names).alias("cold"), by_key.alias("lane"))
    lane = F.when(F.col("hot").isNull(), by_key).otherwise(LANES + F.pmod(F.xxhash64(spread_by), F.lit(LANES)))
    return (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("lane", lane)
        .join(cold, [key, "lane"], "left")
        .select(*rows.columns, F.coalesce("hot", "cold").alias("facts"))
        .select(*rows.columns, *[F.col("facts")[n].alias(n) for n in names])
    )
