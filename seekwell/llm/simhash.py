"""Near duplicates by SimHash: texts whose fingerprints differ in few bits, and the components they form.

Search: the bits of a fingerprint are counted per segment. Two fingerprints at Hamming distance d have count vectors
at Manhattan distance d at most, so points are joined on a grid of count vectors: each goes to every cell
within half the radius, and two points within the radius meet in a cell between them. Those that meet are verified on
all bits. A cell that holds many points is cut to the finest grid, of one-bit segments, where a cell has no more points than a
ball has (65 for radius 1), whatever the data. So no group grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import give_back, small, worker_state, written
from seekwell.llm.components import components, forest
from seekwell.operators.joins import join_facts

SEED = 42
SEGMENT = 4  # bits; a count takes as much room as its bits
CROWDED = 256
CHUNK = 1 << 16
PIECE = 255  # hashes whose bits are counted in one byte each


def fingerprint_of(text: bytes, words: int) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit number; 0 without words."""
    import xxhash

    parts = text.lower().split()  # of bytes: ASCII letters and white space only
    if not parts:
        return 0
    if len(parts) < words:
        shingles, n = iter([b" ".join(parts)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(parts[i:] for i in range(words)))), len(parts) - words + 1
    hashes = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        block = b"".join(h for h, _ in zip(hashes, range(min(CHUNK, n - start))))
        ones += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """64 more bits of each hash (the finaliser of splitmix64)."""
    z = hashes + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_simhash(sets: list[np.ndarray], n_words: int) -> np.ndarray:
    """Fingerprints of 64 * `n_words` bits, a row of booleans per set of 64-bit hashes, none of them empty.

    A bit is the majority of that bit over the set, each hash mixed anew for every 64 bits. Where half of the set has it, the first hash
    decides. Two sets at cosine c differ in about acos(c) / pi of their bits; sets of equal size and resemblance r have cosine 2r / (1 + r).
    """
    # eight counters of a byte each, side by side in 64 bits
    counters = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
    hashes, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    pieces = -(-sizes // PIECE)
    first_piece = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first_piece, pieces)
    piece_starts = np.repeat(starts, pieces) + within * PIECE
    out = np.empty((len(sets), 64 * n_words), bool)
    for number in range(n_words):
        bits = counters[_mixed(hashes, number).view(np.uint8).reshape(-1, 8)]
        counted = np.add.reduceat(bits, piece_starts, axis=0).view(np.uint8)
        ones = np.add.reduceat(counted, first_piece, axis=0, dtype=np.int64)
        out[:, 64 * number : 64 * (number + 1)] = 2 * ones + bits[starts].view(np.uint8) > sizes[:, None]
    return out


def simhash(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """`docs` with the 64-bit SimHash of each whole `text` in column `out` (long; its bits are the fingerprint).

    A-Z are lower-cased; words are what stands between ASCII white space; shingles of `words` words, repeats included,
    are hashed with XXH64; a bit is 1 if it is set in over half of the hashes. A text of fewer words is
    one shingle; a null, empty or blank text has fingerprint 0.
    """

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_state(("simhash",), bool)  # drops what other operators have kept
        try:
            for column in small(batches):
                yield pa.array([fingerprint_of(t or b"", words) for t in column.cast(pa.binary()).to_pylist()], pa.int64())
        finally:
            give_back()

    return docs.withColumn(out, prints(F.col(text)))


def _counts(bits: Column) -> Column:
    """The number of ones of each four bits, in these four bits."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(bits, i).bitwiseAND(ones) for i in range(1, SEGMENT)), bits.bitwiseAND(ones))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _cells(points: DataFrame, fine: bool) -> DataFrame:
    """(fine, cell, bits): each point in its own cell and in those one step away."""
    if fine:
        near = [F.col("bits"), *(F.col("bits").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64))]
    else:
        own = F.col("counts")
        near = [own]
        for i in range(0, 64, SEGMENT):
            count = F.shiftrightunsigned(own, i).bitwiseAND(F.lit(15))
            step = F.lit(1 << i)
            near += [F.when(count < SEGMENT, own + step), F.when(count > 0, own - step)]
        points = points.withColumn("counts", _counts(F.col("bits")))
    cells = points.select("bits", F.explode(F.array(*near)).alias("cell"))
    return cells.where("cell is not null").select(F.lit(fine).alias("fine"), "cell", "bits")


def _meet(max_bits: int):
    """Edges (a, b) that connect all rows of a cell within `max_bits`; rows come sorted by cell."""

    def link(fine: np.ndarray, cell: np.ndarray, bits: np.ndarray) -> pa.RecordBatch | None:
        ends = np.flatnonzero((cell[1:] != cell[:-1]) | (fine[1:] != fine[:-1])) + 1
        starts = np.concatenate([[0], ends])
        size = np.diff(np.concatenate([starts, [len(cell)]]))
        left = np.repeat(size, size) - (np.arange(len(cell)) - np.repeat(starts, size))  # rows of the cell from here on
        found, at, gap = [], np.arange(len(cell)), 1
        while len(at := at[left[at] > gap]):
            close = np.bitwise_count(bits[at] ^ bits[at + gap]) <= max_bits
            found.append((bits[at[close]], bits[at[close] + gap]))
            gap += 1
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1)) if found else ([], [])
        if not len(a):
            return None
        a, b = forest(a.view(np.int64), b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[1]):
                continue
            other = (now[1] != now[1][-1]) | (now[0] != now[0][-1])
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = [x[last:] for x in now]  # the last cell may go on
            if last and (edges := link(*(x[:last] for x in now))) is not None:
                yield edges
        if held is not None and (edges := link(*held)) is not None:
            yield edges

    return meet


def near_fingerprints(prints: DataFrame, bits: str = "fingerprint", max_bits: int = 2) -> DataFrame:
    """(node, root): the component of every distinct fingerprint that has another within `max_bits` (0 to 2) bits.

    `root` is the least fingerprint of the component, as a signed number. Chains count: a and c are together if b is near
    both. Null fingerprints are passed over; an empty table gives an empty table.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("cells within one step meet only up to 2 bits")
    points = prints.select(F.col(bits).alias("bits")).where("bits is not null").distinct()
    cells = _cells(points, fine=False)
    crowded = written(cells.groupBy("cell").count().where(F.col("count") > CROWDED), "crowded")
    marked = cells.join(crowded, "cell", "left")
    again = _cells(marked.where("count is not null").select("bits").distinct(), fine=True)
    rows = marked.where("count is null").select("fine", "cell", "bits").unionAll(again)
    together = rows.repartition("fine", "cell").sortWithinPartitions("fine", "cell")
    return components(together.mapInArrow(_meet(max_bits), "a long, b long"))


def near_components(prints: DataFrame, doc_id: str = "doc_id", bits: str = "fingerprint", max_bits: int = 2) -> DataFrame:
    """`doc_id`, `bits` and `component_id`, the least `doc_id` that is reached over links of at most `max_bits` bits.

    Every row has one, alone or not; equal fingerprints are linked, that of empty texts too. Rows may repeat. A
    null `doc_id` is passed over as a least one, so a component of null ids alone has a null `component_id`.
    """
    rows = prints.select(F.col(doc_id).alias("doc_id"), F.col(bits).alias("bits"))
    points = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    roots = near_fingerprints(points, "bits", max_bits)
    rooted = points.join(roots, F.col("bits") == F.col("node"), "left").withColumn("root", F.coalesce("root", "bits"))
    rooted = written(rooted.select("bits", "n", "least", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(rooted.join(least, "root", "left").select("bits", "n", "component_id"), "facts")
    joined = join_facts(rows, facts, "bits", "n", F.col("doc_id"))
    return joined.select(F.col("doc_id").alias(doc_id), F.col("bits").alias(bits), "component_id")
