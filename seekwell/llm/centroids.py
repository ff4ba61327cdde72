"""Centroid clustering of whole-number vectors, distances bounded from below by Ptolemy's inequality over pivot pairs.

For points x and c and pivots p and s, d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s). A vector's distances to the pivots
are taken once and kept beside it, a centroid's once a round; so a round bounds all distances without touching a component.
The bounds are rounded down. Only centroids that they do not rule out are compared exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import written

PIVOTS = 6
SLACK = 1e-12  # relative; doubles lose less than 1e-15 at each of a handful of steps
LARGEST = 1 << 26  # of a component: squared distances of up to 512 components stay below 2 ** 63
SLICE = 8192  # vectors taken together
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a column of lists of `dim` finite numbers, a row per list."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat.reshape(-1, dim) * scale)
    if np.abs(scaled).max(initial=0.0) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling: distances would not fit a long")
    return scaled.astype(np.int64)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, a row per vector and a column per pivot."""
    out = np.zeros((len(vectors), len(pivots)))
    for i, pivot in enumerate(pivots):
        apart = vectors - pivot
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64))
    return out


def lower_bounds(of_vectors: np.ndarray, of_centroids: np.ndarray, between: np.ndarray) -> np.ndarray:
    """A lower bound of each squared distance (vectors x centroids) from distances to the pivots, rounded down."""
    best = np.zeros((len(of_vectors), len(of_centroids)))
    for p, s in combinations(range(len(between)), 2):
        if between[p, s] > 0:
            one = np.outer(of_vectors[:, p], of_centroids[:, s])
            two = np.outer(of_vectors[:, s], of_centroids[:, p])
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / between[p, s], out=best)
    return best * best * (1 - SLACK)


def nearest(vectors: np.ndarray, of_vectors: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """Nearest centroid of each vector, the smaller number at ties; its squared distance; the number of exact distances taken."""
    bounds = lower_bounds(of_vectors, pivot_distances(centroids, pivots), pivot_distances(pivots, pivots))

    def exact(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        apart = vectors[rows] - centroids[numbers]
        return np.einsum("ij,ij->i", apart, apart)

    everyone = np.arange(len(vectors))
    guess = bounds.argmin(axis=1)
    reached = exact(everyone, guess)
    found = np.full(bounds.shape, np.iinfo(np.int64).max)
    found[everyone, guess] = reached
    bounds[everyone, guess] = np.inf
    taken = len(vectors)
    for number in range(len(centroids)):
        rows = np.flatnonzero(bounds[:, number] <= reached)
        found[rows, number] = exact(rows, np.full(len(rows), number))
        reached[rows] = np.minimum(reached[rows], found[rows, number])
        taken += len(rows)
    cluster = found.argmin(axis=1)
    return cluster, found[everyone, cluster], taken


def _kept(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, vec): the vectors that count, their components as 32-bit whole numbers."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = whole_numbers(batch.column("embedding"), dim, scale).astype(np.int32)
                vec = pa.array([row.tobytes() for row in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec], ["vec_id", "vec"])

    return given.where((F.size("embedding") == dim) & usable).mapInArrow(packed, "vec_id long, vec binary")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), kind)
    return rows.reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, _matrix(part.column("vec"), np.int32).astype(np.int64), _matrix(part.column("away"), np.float64)


def centroid_clusters(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
    dim: int = 64,
    scale: int = 64,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per vector that counts.

    Vectors of exactly `dim` components, none null or not finite, count; a component x becomes floor(scale * x). The `k` vectors
    with the smallest sha256 of "seed:vec_id" are the first centroids; a vector without an id can be one only when there are
    no others left, and of equal ids the smaller vector comes first. Each round assigns all vectors to the nearest centroid (squared distance, the
    smaller number at ties), then moves every centroid that has vectors to floor(sum / count) of each component. At last vectors
    are assigned once more. Repeated rows count as often as they occur; fewer than `k` vectors make as many centroids; no vectors, no
    rows. Components beyond 2 ** 26 are an error. What the driver holds is `k` centroids and their sums.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, vec_id, embedding, dim, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([np.frombuffer(row.vec, np.int32) for row in first]).astype(np.int64)
    pivots = np.unique(centroids, axis=0)[:PIVOTS]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = pivot_distances(_matrix(batch.column("vec"), np.int32).astype(np.int64), pivots)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([row.tobytes() for row in away], pa.binary())], ["vec_id", "vec", "away"]
                )

    ready = written(kept.mapInArrow(measured, "vec_id long, vec binary, away binary"), "vectors")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, rows, away in _slices(batches):
            cluster, _, _ = nearest(rows, away, centroids, pivots)
            np.add.at(sums, cluster, rows)
            counts += np.bincount(cluster, minlength=len(centroids))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    for _ in range(rounds):
        partial = ready.select("vec", "away").mapInArrow(summed, "cluster int, n long, sums array<long>")
        totals = [F.sum(F.col("sums")[i]).alias(f"sum_{i}") for i in range(dim)]
        moved = centroids.copy()
        for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # k rows at most
            moved[row.cluster] = [row[f"sum_{i}"] // row.n for i in range(dim)]
        centroids = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, away in _slices(batches):
            cluster, distance, _ = nearest(rows, away, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    placed = written(ready.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r.cluster: r.inertia for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [
        (number, sums[number], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[number])).encode()).hexdigest())
        for number in sorted(sums)
    ]
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(by_cluster), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))
