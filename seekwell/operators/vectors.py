"""Nearest neighbours by cosine: exact by one scan, and among vectors that share a sign-hyperplane bucket.

Vectors are (vec_id, embedding array<float>), all of one length. A null vector has no
neighbours and is none; one of zeros has cosine 0 with all. A number that is not finite,
a null within a vector, or vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekwell.functions import sign_planes
from seekwell.operators.best import APART, BestRows, merge_best
from seekwell.operators.joins import join_facts
from seekwell.operators.queries import query_blocks
from seekwell.session import durable

SLICE_CELLS = 1 << 21  # scores that are held at once
TILE_ROWS = 1024
KNN_BLOCK_BYTES = 8 << 20  # of queries that one task ranks, so that its time grows with its share of the vectors only
PAIRS = 1 << 15  # pairs that are scored exactly at once
PLACED_ROWS = 1024
HASHED_ROWS = 256
PLACED_BANDS = 16
MAX_BROADCAST_BUCKETS = 1 << 20
SCAN_SHARE = 1 / 8  # of all pairs: where buckets hold as many, repeats counted, all pairs are scored by tiles for less
STRIPE_ROWS = 1 << 16  # vectors whose neighbours one task finds
LEAST_STRIPE_ROWS = 1024
SPREAD_STRIPES = 16  # stripes that are made for more tasks, beyond those that STRIPE_ROWS asks for
STRIPE_PARTS = 4
STRIPE_KEPT = 1 << 20  # best rows that a stripe holds, which makes it smaller where they are many per vector
MAX_KEPT = 1024  # best rows per vector for the sake of ids that vectors share
FIRST_ROWS = 128
FOUND = "neighbour long, cost long, score double, query long"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if not len(lists):
        return np.zeros((0, 0))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("a vector holds a null or a number that is not finite")
    return flat.reshape(len(lists), int(lengths[0]))


def _directions(m: np.ndarray) -> np.ndarray:
    """Rows at length 1, so that inner products are cosines; rows of zeros as they are."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] != b.shape[1] and len(a) and len(b):
        raise ValueError("vectors of different lengths")
    return a @ b.T


def _blur(dim: int) -> float:
    """More than single precision can change the inner product of two directions."""
    return (dim + 16) * 2.0**-23


def _exact(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of rows x of `a` with rows y of `b`, a bounded number of them at a time."""
    parts = (slice(i, i + PAIRS) for i in range(0, len(x), PAIRS))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[x[p]], b[y[p]]) for p in parts)])


def _meetings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `a` and of `b`, buckets by band, have one in common: a x b."""
    met = np.zeros((len(a), len(b)), bool)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        met |= x[:, None] == y
    return met


def _meet(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for rows x of `a` with rows y of `b`, a bounded number of them at a time."""
    parts = (slice(i, i + PAIRS) for i in range(0, len(x), PAIRS))
    return np.concatenate([np.zeros(0, bool), *((a[x[p]] == b[y[p]]).any(axis=1) for p in parts)])


def _offer(
    best: list[BestRows],
    queries: np.ndarray,
    rows: pa.Table,
    items: np.ndarray,
    omit: tuple[np.ndarray, np.ndarray],
    buckets: tuple[np.ndarray, np.ndarray] | None = None,
) -> None:
    """Offer `rows`, with directions `items`, to all queries, a `BestRows` per `TILE_ROWS` of them; `omit` are pairs that do not count.
    With the `buckets` of the queries and of the items, pairs that share none do not count either.

    All pairs are scored in single precision, by tiles, and those that may be among the best once more in double.
    """
    if queries.shape[1] != items.shape[1] and len(queries) and len(items):
        raise ValueError("vectors of different lengths")
    blur, order = _blur(items.shape[1]), np.argsort(omit[0], kind="stable")
    omitted, omitted_rows = omit[0][order], omit[1][order]
    step = max(1, SLICE_CELLS // TILE_ROWS)
    parts = [(first, items[first : first + step].astype(np.float32)) for first in range(0, len(items), step)]
    for number, tile in enumerate(best):
        start = number * TILE_ROWS
        mine = queries[start : start + TILE_ROWS]
        single = mine.astype(np.float32)
        low, high = np.searchsorted(omitted, [start, start + len(mine)])
        for first, part in parts:
            scores = single @ part.T
            own = slice(low, high)
            inside = (omitted_rows[own] >= first) & (omitted_rows[own] < first + len(part))
            scores[omitted[own][inside] - start, omitted_rows[own][inside] - first] = -np.inf
            # cosines are at least -1, and what is left out stays below
            bar = np.maximum(tile.bar - APART - blur, -2).astype(np.float32) - np.float32(2.0**-23)
            near = scores >= bar[:, None]
            met = buckets is None
            if not met and 4 * np.count_nonzero(near) > near.size:
                near &= _meetings(buckets[0][start : start + TILE_ROWS], buckets[1][first : first + step])
                scores[~near] = -np.inf
                met = True
            if met and len(part) > tile.budget and np.count_nonzero(near) > 2 * len(mine) * tile.budget:
                least = np.partition(scores, len(part) - tile.budget, axis=1)[:, len(part) - tile.budget]
                near &= scores >= (least - np.float32(APART + 2 * blur))[:, None]
            query, row = np.divmod(np.flatnonzero(near), len(part))
            row += first
            if not met:
                shared = _meet(buckets[0][start : start + TILE_ROWS], buckets[1], query, row)
                query, row = query[shared], row[shared]
            if len(query):
                tile.offer_pairs(rows, query, row, _exact(mine, items, query, row))


def _tiles(n_queries: int, budget: int) -> list[BestRows]:
    """A `BestRows` for each `TILE_ROWS` of the queries."""
    return [BestRows(min(TILE_ROWS, n_queries - start), budget, ["neighbour"]) for start in range(0, n_queries, TILE_ROWS)]


def _found(best: list[BestRows], ids: np.ndarray) -> Iterator[pa.Table]:
    """What the tiles keep, with the ids of the queries in place of their numbers."""
    for number, tile in enumerate(best):
        found = tile.result()
        if found is not None:
            query = pa.array(ids[number * TILE_ROWS + found["query"].to_numpy()])
            yield found.drop_columns(["query"]).append_column("query", query)


def _equal(ids: np.ndarray, order: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ids, in others) of equal values; `order` sorts `ids`."""
    first = np.searchsorted(ids, others, side="left", sorter=order)
    n = np.searchsorted(ids, others, side="right", sorter=order) - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return order[at], np.repeat(np.arange(len(others)), n)


def _scan(block, budget: int, exclude_self: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        order = np.argsort(ids, kind="stable")
        best = _tiles(len(ids), budget)
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rows.num_rows:
                omit = _equal(ids, order, rows["neighbour"].to_numpy()) if exclude_self else (none, none)
                _offer(best, matrix, rows.drop_columns(["embedding"]), _directions(_matrix(rows["embedding"])), omit)
        for found in _found(best, ids):
            yield from found.combine_chunks().to_batches()

    return run


def knn_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    max_block_bytes: int = KNN_BLOCK_BYTES,
    exclude_self: bool | None = None,
) -> DataFrame:
    """query, rank, neighbour, score: the exact k nearest by cosine.

    `exclude_self` leaves out the vector whose id is the query's: say so where the queries
    are some of the vectors. By default it is on only if both are the same DataFrame.
    Work is queries x vectors, as exactness asks, in single precision first; what leaves a task is k rows
    per query. For all vectors against all, `knn_lsh` is the way at scale.
    """
    spark = vectors.sparkSession
    exclude_self = queries is vectors if exclude_self is None else exclude_self
    items = vectors.where(F.col("embedding").isNotNull()).select(
        F.col("vec_id").alias("neighbour"), F.lit(1).cast("long").alias("cost"), "embedding"
    )
    sized = queries.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    size = F.size("embedding").cast("long") * 8 + 16
    found = []
    for block in query_blocks(sized, size, max_block_bytes):
        if block.num_rows:
            shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), _directions(_matrix(block["embedding"]))))
            found.append(items.mapInArrow(_scan(shared, k, exclude_self), FOUND))
    if not found:
        found = [spark.createDataFrame([], FOUND)]
    best = merge_best(reduce(DataFrame.unionByName, found), ["query"], ["neighbour"], k)
    return best.select("query", "rank", "neighbour", "score")


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task that turns (vec_id, embedding) to (vec_id, vec): the floats as bytes.

    Bytes are grouped, joined and sorted as they are; arrays of floats would be
    normalized and compared number by number each time.
    """
    for batch in batches:
        if batch.num_rows:
            # + 0.0 makes -0.0 and 0.0 the same bytes
            m = _matrix(pa.chunked_array([batch.column("embedding")])).astype(np.float32) + np.float32(0.0)
            vec = pa.array([row.tobytes() for row in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec], ["vec_id", "vec"])


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    packed = column.to_pylist()
    flat = np.frombuffer(b"".join(packed), dtype=np.float32).astype(np.float64)
    return flat.reshape(len(packed), -1) if packed else flat.reshape(0, 0)


def _hasher(dim: int, bits: int, bands: int):
    """Bucket numbers of a batch: vectors x bands, the band in the high bits."""
    planes = sign_planes(bits * bands, dim)
    place = 2.0 ** np.arange(bits)
    base = np.arange(bands, dtype=np.int64) << bits

    def buckets(column: pa.ChunkedArray) -> np.ndarray:
        above = _cosines(_unpack(column), planes) > 0
        return (above.reshape(-1, bands, bits) @ place).astype(np.int64) + base

    return buckets


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows some at a time, so that the sides of all their planes are few megabytes whatever a batch holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, PLACED_ROWS):
            yield pa.Table.from_batches([batch.slice(start, PLACED_ROWS)])


def _place(dim: int, bits: int, bands: int):
    """The task that puts each vector under its bucket of every band."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _hasher(dim, bits, bands)
        for rows in _slices(batches):
            keys = buckets(rows["vec"]).T
            for start in range(0, bands, PLACED_BANDS):
                some = keys[start : start + PLACED_BANDS]
                copied = rows.take(pa.array(np.tile(np.arange(rows.num_rows), len(some))))
                yield from copied.append_column("bucket", pa.array(some.ravel())).combine_chunks().to_batches()

    return run


def _count(dim: int, bits: int, bands: int):
    """The task that counts its vectors per bucket, and sends the counts alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _hasher(dim, bits, bands)
        for rows in _slices(batches):
            keys, n = np.unique(buckets(rows["vec"]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["bucket", "n"])

    return run


def _cell(k: int):
    """The task for one cell: the best of its two blocks for each other."""

    def one_way(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        ids, others = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        # a vector meets itself only where it stands for copies
        alone = pc.list_value_length(a["ids"]).to_numpy() == 1
        query, row = _equal(ids, np.argsort(ids, kind="stable"), others)
        omit = query[alone[query]], row[alone[query]]
        rows = pa.table({"neighbour": others, "ids": b["ids"], "cost": np.ones(len(others), dtype=np.int64)})
        best = _tiles(len(ids), k)
        _offer(best, _directions(_unpack(a["vec"])), rows, _directions(_unpack(b["vec"])), omit)
        for found in _found(best, ids):
            yield found.select(["neighbour", "ids", "score", "query"])

    def run(rows: pa.Table) -> pa.Table:
        left = pc.equal(rows["block"], rows["cell_i"])
        a, b = rows.filter(left), rows.filter(pc.invert(left))
        found = [*one_way(a, b), *one_way(b, a)] if b.num_rows and a.num_rows else []
        if rows["cell_i"][0] == rows["cell_j"][0]:
            found = [*one_way(rows, rows)]
        return pa.concat_tables(found) if found else MET_SCHEMA.empty_table()

    return run


MET = "neighbour long, ids array<long>, score double, query long"
MET_SCHEMA = pa.schema(
    [
        ("neighbour", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("score", pa.float64()),
        ("query", pa.int64()),
    ]
)


def _stripe(k: int, dim: int, bits: int, bands: int):
    """The task for one stripe: its vectors come first, then as items those that may be near them, of which it keeps the best."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hasher(dim, bits, bands)

        def buckets(rows: pa.Table) -> np.ndarray:
            keys = np.empty((rows.num_rows, bands), np.uint16 if bits <= 16 else np.int64)
            for start in range(0, rows.num_rows, HASHED_ROWS):
                keys[start : start + HASHED_ROWS] = hashed(rows["vec"].slice(start, HASHED_ROWS)) & ((1 << bits) - 1)
            return keys

        held, best, width = [], None, FIRST_ROWS
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            n = int(np.count_nonzero(~rows["item"].to_numpy(zero_copy_only=False)))
            if n:
                held.append(rows.slice(0, n).select(["vec_id", "ids", "vec"]).combine_chunks())
            if best is None and n < rows.num_rows and held:
                asked = pa.concat_tables(held)
                ids, alone = asked["vec_id"].to_numpy(), pc.list_value_length(asked["ids"]).to_numpy() == 1
                own, directions, order = buckets(asked), _directions(_unpack(asked["vec"])), np.argsort(ids, kind="stable")
                best = _tiles(len(ids), k)
            while best is not None and n < rows.num_rows:
                # few rows at first, as all are near until a query has its best
                items = rows.slice(n, width)
                n, width = n + width, min(4 * width, rows.num_rows)
                # a vector meets itself only where it stands for copies
                query, row = _equal(ids, order, items["vec_id"].to_numpy())
                omit = query[alone[query]], row[alone[query]]
                offered = items.select(["vec_id", "ids"]).rename_columns(["neighbour", "ids"])
                offered = offered.append_column("cost", pa.array(np.ones(items.num_rows, dtype=np.int64)))
                _offer(best, directions, offered, _directions(_unpack(items["vec"])), omit, (own, buckets(items)))
        for found in _found(best or [], ids if best else np.zeros(0)):
            yield from found.select(["neighbour", "ids", "score", "query"]).combine_chunks().to_batches()

    return run


def _scanned(distinct: DataFrame, n: int, k: int, dim: int, bits: int, bands: int) -> DataFrame:
    """MET: for each of `n` vectors the best `k` that share a bucket, found by a scan of all.

    Vectors are cut in stripes, each a task's, to which all vectors are sent: a vector is copied once per stripe, and for a task per stripe and
    part of the vectors where stripes are fewer than cores. A task holds its stripe and what is best for that, whatever the number of vectors.
    """
    cores = distinct.sparkSession.sparkContext.defaultParallelism
    needed = max(1, ceil(n / min(STRIPE_ROWS, max(LEAST_STRIPE_ROWS, STRIPE_KEPT // k))))
    stripes = max(needed, min(2 * cores, SPREAD_STRIPES, ceil(n / LEAST_STRIPE_ROWS)))
    parts = min(ceil(2 * cores / stripes), STRIPE_PARTS, needed)
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    carried = ["vec_id", "ids", "vec"]
    asked = distinct.select(*carried, place(0, stripes).alias("stripe"), upto(parts).alias("part"))
    items = distinct.select(*carried, upto(stripes).alias("stripe"), place(1, parts).alias("part"))
    both = asked.withColumn("item", F.lit(False)).unionAll(items.select(*asked.columns).withColumn("item", F.lit(True)))
    task = F.col("stripe") * parts + F.col("part")
    dealt = both.select("item", *carried, task.alias("task")).repartitionById(stripes * parts, "task")
    dealt = dealt.sortWithinPartitions("item").select("item", *carried)
    return dealt.mapInArrow(_stripe(k, dim, bits, bands), MET)


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """vec, n, vec_id, ids: each distinct vector, how many hold it, and its lowest k + 1 ids.

    The lowest id stands for all copies. Rows of a vector are cut in as many lanes as there are shuffle
    partitions first, so that one that a third of the rows share is never one task's work, whatever k.
    """
    lanes = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_lane = Window.partitionBy("vec", "lane").orderBy("vec_id")
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    lowest = (
        vectors.withColumn("lane", F.pmod(F.xxhash64("vec_id"), F.lit(lanes)))
        .withColumn("nth", F.row_number().over(by_lane))
        .where(F.col("nth") <= k + 1)
        .withColumn("nth", F.row_number().over(by_id))
        .where(F.col("nth") <= k + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    counted = vectors.groupBy("vec").agg(F.count("*").alias("n"))
    return counted.join(lowest, "vec").select("vec", "n", F.col("ids")[0].alias("vec_id"), "ids")


def _met_in_buckets(distinct: DataFrame, k: int, dim: int, bits: int, bands: int, block_rows: int) -> DataFrame:
    """MET: for every vector the best `k` of each cell, in every bucket that it is in. A vector is copied once per band."""
    sizes = (
        distinct.select("vec")
        .mapInArrow(_count(dim, bits, bands), "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > block_rows)
        .select("bucket", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("n_blocks"))
    )
    placed = distinct.select("vec_id", "ids", "vec").mapInArrow(
        _place(dim, bits, bands), "vec_id long, ids array<long>, vec binary, bucket long"
    )
    # buckets are bands x 2^bits at most, whatever the number of vectors
    if bands << bits <= MAX_BROADCAST_BUCKETS:
        sized = placed.join(F.broadcast(sizes), "bucket", "left")
    else:
        sized = join_facts(placed, durable(sizes), "bucket", "n", F.col("vec_id"))
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    carried = ["vec_id", "ids", "vec", "bucket", "block"]
    cells = (
        sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
        .select(*carried, F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
        .select(
            *carried,
            F.least("block", "other").alias("cell_i"),
            F.greatest("block", "other").alias("cell_j"),
        )
    )
    return cells.groupBy("bucket", "cell_i", "cell_j").applyInArrow(_cell(k), MET)


def knn_lsh(
    vectors: DataFrame,
    k: int = 10,
    dim: int = 64,
    *,
    bits: int,
    bands: int,
    block_rows: int = 2048,
) -> DataFrame:
    """query, rank, neighbour, score: the nearest among vectors that share a bucket.

    Scores are exact; a neighbour that shares no bucket is missed: one at angle a is met with chance
    1 - (1 - (1 - a / pi)^bits)^bands. Work is about bands / 2^bits of all pairs where vectors lie evenly, so
    `bits` has to be chosen for the data: near log2(rows / block_rows) a usual bucket is one cell.

    Copies of a vector are hashed once. Where bands / 2^bits is `SCAN_SHARE` or more, a copy of each vector per band and the best rows of each
    bucket would be far more than the vectors, for as many pairs as a scan has: stripes of vectors scan all then, and the pairs that may be among
    the best count if they share a bucket. Else vectors meet in their buckets. A bucket that holds more than
    `block_rows` vectors is cut in blocks, and each pair of blocks is a cell and
    a group of its own: no task holds more than two blocks, and a cell sends at
    most k + 1 rows per vector, never its pairs.
    """
    given = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    rows = given.mapInArrow(_pack, "vec_id long, vec binary")
    distinct = durable(_distinct(rows, k))
    held = distinct.groupBy("vec_id").agg(F.count("*").alias("held")).agg(F.sum("held"), F.max("held")).first()
    n, repeats = held[0] or 0, held[1] or 1
    # a band's buckets hold a share of 2^-bits of all pairs at least, however the vectors lie
    if bands >= SCAN_SHARE * (1 << bits) and (repeats == 1 or (k + 1) * repeats <= MAX_KEPT):
        # ids should be unique; where several vectors share one, the best k + 1 ids lie in so many more rows
        met = _scanned(distinct, n, (k + 1) * repeats, dim, bits, bands)
    else:
        met = _met_in_buckets(distinct, k + 1, dim, bits, bands, block_rows)
    # The best k + 1 rows of a query lie in the best k + 1 distinct vectors, ordered by their
    # lowest ids. One shuffle by query serves all of this: a pair met in several bands once,
    # the best vectors, and their copies.
    by_vector = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = (
        met.repartition("query")
        .groupBy("query", "neighbour")
        .agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
        .withColumn("nth", F.row_number().over(by_vector))
        .where(F.col("nth") <= k + 1)
        .select("query", "score", F.explode("ids").alias("id"))
        .withColumn("nth", F.row_number().over(by_row))
        .where(F.col("nth") <= k + 1)
        .groupBy("query")
        .agg(F.collect_list(F.struct("nth", "id", "score")).alias("best"))
    )
    # every copy takes the list of the vector that stands for it, and leaves itself out
    facts = durable(
        distinct.select("vec", "n", F.col("vec_id").alias("query")).join(best, "query").drop("query")
    )
    others = F.filter(F.sort_array("best"), lambda b: b["id"] != F.col("vec_id"))
    return (
        join_facts(rows, facts, "vec", "n", F.col("vec_id"))
        .select(F.col("vec_id").alias("query"), F.posexplode(F.slice(others, 1, k)).alias("nth", "b"))
        .select(
            "query",
            (F.col("nth") + 1).cast("long").alias("rank"),
            F.col("b.id").alias("neighbour"),
            F.col("b.score").alias("score"),
        )
    )
