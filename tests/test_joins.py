"""Joins with one fact per key, hot keys and wide facts."""

import pytest
from pyspark.sql import functions as F

from seekwell.operators import joins
from seekwell.operators.joins import join_facts


def frames(spark):
    """Two keys hold two thirds of the rows; some keys have no fact, and some facts no rows."""
    rows = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 500).cast("long").alias("key")
    )
    facts = rows.where("key % 7 <> 3").groupBy("key").agg(F.count("*").alias("n")).unionAll(spark.createDataFrame([(9999, 5)], "key long, n long"))
    wide = facts.select(
        "key", "n", F.repeat(F.lit("x"), 1000 + F.col("key").cast("int")).alias("text"), F.sequence(F.lit(0), F.lit(50)).alias("list"),
        F.struct(F.lit("s").alias("s")).alias("inner"), F.when(F.col("key") == 1, F.lit(None)).otherwise(F.lit(b"ab")).alias("raw"),
    )
    return rows, wide


@pytest.mark.parametrize("most", [64 << 20, 100])
def test_wide_facts(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MAX_HOT_BYTES", most)
    rows, facts = frames(spark)
    got = join_facts(rows, facts, "key", "n", F.col("id"))
    assert got.columns == ["id", "key", "n", "text", "list", "inner", "raw"]
    known = {r.key: r for r in facts.collect()}
    found = got.collect()
    assert len(found) == 9000 and len({r.id for r in found}) == 9000
    for r in found:
        fact = known.get(r.key)
        assert (r.n, r.text, r.list, r.raw) == ((fact.n, fact.text, fact.list, fact.raw) if fact else (None,) * 4)


def test_hot_facts_that_are_wide_are_not_broadcast(spark, monkeypatch):
    rows, facts = frames(spark)
    before = join_facts(rows, facts, "key", "n", F.col("id"))
    assert "lanes" not in str(before._jdf.queryExecution().analyzed())
    monkeypatch.setattr(joins, "MAX_HOT_BYTES", 100)
    after = join_facts(rows, facts, "key", "n", F.col("id"))
    hint = str(after._jdf.queryExecution().analyzed()).split("ResolvedHint")[1:]
    assert len(hint) == 1
    assert "lanes" in hint[0].split("\n")[1] and "text" not in hint[0].split("\n")[1]
    # each hot key's rows are dealt to several tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = after.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 9000 / 2


def test_facts_of_nothing(spark):
    rows, facts = frames(spark)
    assert join_facts(rows.limit(0), facts, "key", "n", F.col("id")).count() == 0
    assert join_facts(rows, facts.limit(0), "key", "n", F.col("id")).where("n is null").count() == 9000
