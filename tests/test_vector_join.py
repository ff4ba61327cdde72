"""The threshold join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekwell.operators import vector_join, vector_join_work

COLUMNS = "vec_id long, embedding array<float>"


def plain(data, threshold):
    kept = [(i, np.array(v, np.float32).astype(np.float64) + 0.0) for i, v in data if v is not None]
    m = np.array([v for _, v in kept])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    unit = m / np.where(norm > 0, norm, 1)
    match = np.round(unit @ unit.T, 6) >= threshold
    np.fill_diagonal(match, False)
    least = {}
    for i, v in kept:
        least[v.tobytes()] = min(i, least.get(v.tobytes(), i))
    return sorted((i, least[v.tobytes()], int(n)) for (i, v), n in zip(kept, match.sum(axis=1)))


def clustered(n, dim, seed, spread):
    """Groups around a few directions; a third of the rows are one vector; nulls, zeros, scaled copies, opposite vectors."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, dim))
    rows = middles[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * spread
    data = [(7 * i, v.tolist()) for i, v in enumerate(rows.astype(np.float32))]
    data += [(100_000 + i, data[5][1]) for i in range(n // 2)]
    data += [(200_000, None), (200_001, [0.0] * dim), (200_002, [-0.0] * dim)]
    return data + [(200_003, [2 * x for x in data[0][1]]), (200_004, [-x for x in data[0][1]])]


@pytest.mark.parametrize(
    ("threshold", "spread", "pivots", "block_rows"),
    [(0.05, 0.5, 5, 20), (0.4, 0.1, 16, 2048), (0.4, 3.0, 1, 50), (0.8, 0.5, 5, 20), (0.97, 0.1, 16, 30), (1.0, 0.5, 5, 2048)],
)
def test_equals_all_pairs(spark, threshold, spread, pivots, block_rows):
    data = clustered(200, 6, 3, spread)
    frame = spark.createDataFrame(data, COLUMNS).repartition(4).withColumns({"n": F.lit(1), "cell": F.lit("own"), "links": F.lit(0)})
    got = vector_join(frame, threshold, pivots, block_rows)
    assert got.columns == ["vec_id", "class_id", "links"]
    want = plain(data, threshold)
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[2] for r in want}) > 1


def test_edges(spark):
    assert vector_join(spark.createDataFrame([], COLUMNS), 0.5).count() == 0
    assert vector_join(spark.createDataFrame([(1, None)], COLUMNS), 0.5).count() == 0
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], COLUMNS)
    assert sorted(map(tuple, vector_join(one, 0.5).collect())) == [(1, 1, 0), (2, 1, 0)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], COLUMNS)
    assert {tuple(r)[1:] for r in vector_join(same, 1.0).collect()} == {(0, 49)}
    for wrong in (0.0, -0.5, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            vector_join(one, wrong)


def test_work_is_spared_where_vectors_lie_in_groups(spark):
    grouped = spark.createDataFrame(clustered(600, 16, 1, 0.05), COLUMNS)
    work = vector_join_work(grouped, 0.95, block_rows=64)
    assert work["comparisons"] < 0.4 * work["pairs"] and work["vectors"] <= work["places"] <= 16 * work["vectors"]
    even = spark.createDataFrame(clustered(600, 16, 1, 50.0), COLUMNS)
    assert vector_join_work(even, 0.2)["comparisons"] >= 0.9 * work["pairs"]


def test_visitors_are_not_compared_with_each_other(spark):
    """Vectors that lie evenly are all compared, but each pair once, however many pivots both visit."""
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 24)))], COLUMNS)
    work = vector_join_work(frame, 0.2, block_rows=64)
    assert work["places"] > 6 * work["vectors"]
    assert work["comparisons"] <= work["pairs"]
