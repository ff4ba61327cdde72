"""All vectors at a cosine of at least a threshold: an exact join by pivots and the triangle inequality of angles.

Every vector is at home with its nearest pivot. A pair is compared where the lower-numbered of its two homes is, so a vector
also visits those lower pivots whose vectors it may reach: angles obey the triangle inequality, so none is within the limit of
any vector of pivot p if its angle to p exceeds the radius of p's vectors by more than the limit, or its angle to its own
pivot by more than twice the limit. With a pivot, vectors lie in rings by their angle to it, and rings further apart than the
limit are not compared. What remains is compared in blocks inside tasks; what leaves a task is a number per vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.operators.best import SCORE_DIGITS
from seekwell.operators.joins import join_facts
from seekwell.operators.vectors import SLICE_CELLS, _blur, _directions, _exact, _pack, _unpack
from seekwell.session import durable, written

PIVOTS = 16
SLACK = 2e-6  # of angles: for scores rounded to 6 digits, and for the rounding of angles
LEAST_RING = 0.02
BLOCK_ROWS = 16384
PLACED = "vec_id long, n long, vec binary, home int, away double"
VISITS = "vec_id long, n long, vec binary, cell int, ring int, at_home boolean"


def _limit(threshold: float) -> float:
    """The largest angle of two vectors whose rounded cosine reaches the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be above 0 and at most 1")
    return acos(max(-1.0, threshold - 10.0**-SCORE_DIGITS)) + SLACK


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _settle(pivots: np.ndarray):
    """(vec_id, n, vec) to PLACED. Vectors of zeros have cosine 0 with all, and so no place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _directions(_unpack(batch.column("vec")))
                angles = _angles(rows, pivots)
                home = angles.argmin(axis=1)
                out = pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home, pa.int32()), pa.array(angles[np.arange(len(home)), home])],
                    ["vec_id", "n", "vec", "home", "away"],
                )
                yield out.filter(pa.array(rows.any(axis=1)))

    return run


def _visit(pivots: np.ndarray, radius: np.ndarray, limit: float, ring: float):
    """PLACED to VISITS: a row for the home of each vector, and one for each lower pivot that it may reach into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_directions(_unpack(batch.column("vec"))), pivots)
            home, away = batch.column("home").to_numpy(), batch.column("away").to_numpy()
            reach = (angles - away[:, None] <= 2 * limit) & (angles <= radius + limit)
            reach &= np.arange(len(pivots)) < home[:, None]
            reach[np.arange(len(home)), home] = True
            row, cell = np.nonzero(reach)
            same = batch.select(["vec_id", "n", "vec"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*same.columns, pa.array(cell, pa.int32()), pa.array((angles[row, cell] / ring).astype(np.int32)), pa.array(cell == home[row])],
                ["vec_id", "n", "vec", "cell", "ring", "at_home"],
            )

    return run


def _cells(visits: DataFrame, reach: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Visits copied to pairs of blocks (cell, low, high), and the blocks of each ring. Blocks are of vectors at home or of visitors;
    two blocks of visitors are no pair, as theirs are compared elsewhere."""
    rings = visits.groupBy("cell", "ring", "at_home").agg(F.count("*").alias("rows"))
    rings = rings.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long"))
    rings = durable(rings)  # pivots x rings rows, whatever the number of vectors
    code = lambda ring, at_home, block: (ring.cast("long") * 2 + at_home.cast("long")) * F.lit(1 << 32) + block
    to = rings.select("cell", F.col("ring").alias("to_ring"), F.col("at_home").alias("to_home"), F.col("blocks").alias("to_blocks"))
    near = rings.join(F.broadcast(to), "cell")
    near = near.where((F.abs(F.col("ring") - F.col("to_ring")) <= reach) & (F.col("at_home") | F.col("to_home")))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("to_blocks") - 1)
    partners = F.flatten(F.collect_list(F.transform(numbers, lambda i: code(F.col("to_ring"), F.col("to_home"), i))))
    near = near.groupBy("cell", "ring", "at_home", "blocks").agg(partners.alias("partners"))
    own = code(F.col("ring"), F.col("at_home"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    copied = visits.join(F.broadcast(near), ["cell", "ring", "at_home"]).select("*", own.alias("own"), F.explode("partners").alias("other"))
    return copied.select(
        "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") <= F.col("other")).alias("in_low"), "vec_id", "n", "vec",
    ), rings


def _matches(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in a, positions in b) of pairs that reach the threshold, some rows of `a` at a time.

    Pairs are scored in single precision, and once more in double where that leaves a doubt.
    """
    doubt = _blur(a.shape[1]) + 2 * 10.0**-SCORE_DIGITS
    others, step = b.astype(np.float32).T, max(1, SLICE_CELLS // max(1, len(b)))
    for start in range(0, len(a), step):
        scores = (a[start : start + step].astype(np.float32) @ others).ravel()
        at = np.flatnonzero(scores >= threshold - doubt)
        x, y = np.divmod(at, len(b))
        x += start
        sure = scores[at] >= threshold + doubt
        unsure = np.flatnonzero(~sure)
        sure[unsure] = np.round(_exact(a, b, x[unsure], y[unsure]), SCORE_DIGITS) >= threshold
        yield x[sure], y[sure]


def _count(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, n = rows["vec_id"].to_numpy(), rows["n"].to_numpy()
        in_low = rows["in_low"].to_numpy(zero_copy_only=False)
        one_block = rows["low"][0].as_py() == rows["high"][0].as_py()
        a = np.flatnonzero(in_low)
        b = a if one_block else np.flatnonzero(~in_low)
        vectors = _directions(_unpack(rows["vec"]))
        links = np.zeros(len(ids), np.int64)
        for x, y in _matches(vectors[a], vectors[b], threshold):
            x, y = a[x], b[y]
            if one_block:  # a vector is no link of itself
                x, y = x[x != y], y[x != y]
            # sums of numbers of rows are exact in doubles
            links += np.bincount(x, weights=n[y], minlength=len(ids)).astype(np.int64)
            if not one_block:
                links += np.bincount(y, weights=n[x], minlength=len(ids)).astype(np.int64)
        met = np.flatnonzero(links)
        return pa.table({"vec_id": ids[met], "links": links[met]})

    return run


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as (vec_id, vec), and the distinct vectors (vec, n, vec_id), the least id standing for all copies."""
    given = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    rows = given.mapInArrow(_pack, "vec_id long, vec binary")
    return rows, durable(rows.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id")))


def _placed(distinct: DataFrame, threshold: float, pivots: int, block_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """The cells of the join and the rings of each pivot; None without vectors."""
    limit = _limit(threshold)
    zeros = F.regexp_replace(F.hex("vec"), "0", "") == ""
    chosen = distinct.where(~zeros).orderBy(F.xxhash64("vec"), "vec").limit(pivots).select("vec").collect()  # `pivots` rows
    if not chosen:
        return None
    centers = _directions(_unpack(pa.chunked_array([pa.array([bytes(r.vec) for r in chosen])])))
    placed = durable(distinct.select("vec_id", "n", "vec").mapInArrow(_settle(centers), PLACED))
    radius = np.zeros(len(centers))
    for row in placed.groupBy("home").agg(F.max("away").alias("away")).collect():
        radius[row.home] = row.away
    ring = max(limit / 2, LEAST_RING)
    visits = written(placed.mapInArrow(_visit(centers, radius, limit, ring), VISITS), "visits")
    return _cells(visits, min(ceil(limit / ring), ceil(pi / ring)), block_rows)


def vector_join(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, class_id, links): of every vector, the least id of those equal to it, and how many others lie within the threshold.

    A link is another row whose cosine, rounded to 6 digits, is at least `threshold` (above 0, at most 1); copies of a vector are links of each
    other. A null vector has no row; one of zeros has no links. Exact whatever the vectors: pivots, which are `pivots` of them
    by hash, decide only what can be spared. A vector is placed once for its home and at most once for each pivot before that. Vectors that lie evenly
    in many dimensions cannot be told apart by angles to pivots, and are then all compared; see `vector_join_work`.
    """
    rows, distinct = _classes(vectors)
    found = _placed(distinct, threshold, pivots, block_rows)
    if found is None:
        others = rows.sparkSession.createDataFrame([], "vec_id long, links long")
    else:
        others = found[0].groupBy("cell", "low", "high").applyInArrow(_count(threshold), "vec_id long, links long")
    summed = others.groupBy("vec_id").agg(F.sum("links").alias("links"))
    zeros = F.regexp_replace(F.hex("vec"), "0", "") == ""
    of_copies = F.when(zeros, F.lit(0)).otherwise(F.col("n") - 1)
    links: Column = F.coalesce("links", F.lit(0)) + of_copies
    facts = distinct.join(summed, "vec_id", "left").select("vec", "n", F.col("vec_id").alias("class_id"), links.cast("long").alias("links"))
    return join_facts(rows, durable(facts), "vec", "n", F.col("vec_id")).select("vec_id", "class_id", "links")


def vector_join_work(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> dict[str, int]:
    """What the join does, before it is done: distinct vectors, places that they take, comparisons, and all pairs there are."""
    _, distinct = _classes(vectors)
    total = distinct.count()
    found = _placed(distinct, threshold, pivots, block_rows)
    if found is None:
        return {"vectors": total, "places": 0, "comparisons": 0, "pairs": total * (total - 1) // 2}
    cells, rings = found
    a, b = F.sum(F.col("in_low").cast("long")), F.sum((~F.col("in_low")).cast("long"))
    sizes = cells.groupBy("cell", "low", "high").agg(a.alias("a"), b.alias("b"))
    pairs = F.when(F.col("low") == F.col("high"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b"))
    return {
        "vectors": total,
        "places": rings.agg(F.sum("rows")).first()[0],
        "comparisons": int(sizes.agg(F.sum(pairs)).first()[0] or 0),
        "pairs": total * (total - 1) // 2,
    }
