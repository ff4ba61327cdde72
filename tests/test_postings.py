from collections import Counter

from pyspark.sql import functions as F

from seekwell.operators import inverted_index
from seekwell.operators.joins import HOT_PER_PARTITION, join_facts
from seekwell.session import durable


def brute(docs):
    lists = {i: (t or "").lower().split() for i, t in docs}
    df = Counter(t for ws in lists.values() for t in set(ws))
    return {
        (t, i, n, df[t], len(ws)) for i, ws in lists.items() for t, n in Counter(ws).items()
    }


def test_index_with_hot_and_cold_terms(spark):
    docs = [(i, f"the The a{i} b{i % 5} c{i}x c{i}x") for i in range(1500)] + [(9000, None), (9001, ""), (9002, "the")]
    got = inverted_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    rows = {(r["term"], r["doc_id"], r["tf"], r["df"], r["doc_len"]) for r in got.collect()}
    assert rows == brute(docs)
    df = {t: d for t, _, _, d, _ in rows}
    total = sum(df.values())
    hot = HOT_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert any(d * hot >= total for d in df.values()) and any(d * hot < total for d in df.values())


def test_hot_rows_are_spread_and_none_is_lost(spark):
    rows = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")
    )
    facts = durable(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        # force the shuffle that a large dictionary gets
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = join_facts(rows, facts, "key", "n", F.col("id"))
        # the facts are used, so that the join is not optimized away
        sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("top").alias("n")).collect()
        assert got.where(F.col("n").isNull()).count() == 0
        assert got.where((F.col("key") == "hot") & (F.col("n") == 10000) & (F.col("top") == 29997)).count() == 10000
        assert got.count() == 30000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(sizes) == 8 and sum(r["n"] for r in sizes) == 30000
    assert max(r["n"] for r in sizes) < 1.2 * 30000 / len(sizes)


def test_keys_just_below_hot_leave_partitions_even(spark):
    n, parts = 32000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    below = n // (HOT_PER_PARTITION * parts) - 1
    key = F.when(F.col("id") < 5 * below, (F.col("id") / below).cast("int")).otherwise(F.col("id"))
    rows = spark.range(n).select("id", key.alias("key"))
    facts = durable(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = join_facts(rows, facts, "key", "n", F.col("id"))
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("top").alias("n")).collect()]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sum(sizes) == n and max(sizes) < 2 * n / parts
