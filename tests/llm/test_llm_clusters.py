"""Centroid clustering against brute force."""

import hashlib

import numpy as np
import pytest
from llm_cases import clashing
from pyspark.sql import functions as F

from seekwell.llm.centroids import PIVOTS, centroid_clusters, lower_bounds, nearest, pivot_distances

COLUMNS = "vec_id long, embedding array<float>"
NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k, rounds, dim, scale=64, seed=1):
    """The same in plain Python whole numbers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            kept.append((vec_id, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]))
    named = [r for r in kept if r[0] is not None]
    named.sort(key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in named[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        best = assign()
        for i in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, best) if c == i]
            if mine:
                centroids[i] = [sum(col) // len(mine) for col in zip(*mine)]
    best = assign()
    total = sum(d for d, _ in best)
    out = []
    for (vec_id, _), (d, c) in zip(kept, best):
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        out.append((vec_id, c, d, sum(x for x, y in best if y == c), total, digest))
    return sorted(out, key=repr)


def cases(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * 0.2]) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(n // 2)]  # a third are one vector
    odd = [None, [], same[:-1], [*same, 0.0], [None, *same[1:]], [float("nan"), *same[1:]], [float("inf"), *same[1:]]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, same), (7, same), (7, rows[1][1])]


@pytest.mark.parametrize(("n", "k", "rounds", "dim"), [(90, 8, 3, 4), (40, 16, 1, 6), (60, 5, 0, 3), (5, 16, 2, 2)])
def test_equals_brute_force(spark, n, k, rounds, dim):
    rows = cases(n, dim, n)
    rows = [r for r in rows if r[0] != 7 or k < 16]  # not where both rows of id 7 would be first centroids
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, COLUMNS).repartition(parts)
        got = centroid_clusters(clashing(frame, "cluster", "vec", "away", "n"), k, rounds, dim=dim)
        assert got.columns == NAMES
        want = plain(rows, k, rounds, dim)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_no_vectors(spark):
    empty = centroid_clusters(spark.createDataFrame([], COLUMNS))
    assert empty.columns == NAMES and empty.count() == 0
    assert centroid_clusters(spark.createDataFrame([(1, None), (2, [1.0])], COLUMNS)).count() == 0


def test_all_vectors_are_one(spark):
    frame = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.lit(-0.51).cast("float")] * 64).alias("embedding"))
    got = centroid_clusters(frame).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 300


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        centroid_clusters(spark.createDataFrame([(1, [1e30] * 64)], COLUMNS)).collect()


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    middles = rng.integers(-40, 40, (16, 64))
    vectors = middles[rng.integers(0, 16, 4000)] + rng.integers(-4, 5, (4000, 64))
    pivots = vectors[:PIVOTS]
    centroids = np.concatenate([middles[:15], middles[:1]])  # a tie
    away = pivot_distances(vectors, pivots)
    exact = ((vectors[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    bounds = lower_bounds(away, pivot_distances(centroids, pivots), pivot_distances(pivots, pivots))
    assert (bounds <= exact).all() and bounds.max() > 0.5 * exact.max()
    cluster, distance, taken = nearest(vectors, away, centroids, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert len(vectors) <= taken < 0.6 * exact.size
    # a centroid on a pivot, and pivots that are one point, bound nothing wrongly
    same = np.repeat(vectors[:1], PIVOTS, axis=0)
    cluster, _, taken = nearest(vectors, pivot_distances(vectors, same), centroids, same)
    assert (cluster == exact.argmin(axis=1)).all() and taken >= exact.size
