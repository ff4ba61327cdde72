"""Packing of token sequences: best fit, with the large items matched first.

Lengths are whole numbers up to the capacity, so what has to be decided is how many items of each length share a
sequence with which others: a plan over one count per length, whose size the capacity bounds and not the input. Items
above a third of the capacity are at most two to a sequence, and are matched greedily, the longest with the longest
that still fits. The others, longest first, go to the sequences with the least room that takes them. Spark
counts, ranks the items of each length, and looks each up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekwell.llm.library_ids import encode_ids

LANES = 512
RANKS = 1 << 44


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and `end_id`, in pieces of `capacity` ids where there
    are more. `ids` is binary, little-endian unsigned 32-bit numbers. A null or empty text is the end id alone."""
    ids = encode_ids(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer, end_id=end_id)
    n = F.octet_length("ids") / 4
    pieces = ids.select("doc_id", "ids", F.explode(F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1)).alias("piece"))
    part = F.expr(f"substring(ids, piece * {4 * capacity} + 1, {4 * capacity})")
    return pieces.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        (F.octet_length(part) / 4).cast("long").alias("length"),
        part.alias("ids"),
    )


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, items per sequence, first sequence, offset): from that rank on, items of that length
    go to consecutive sequences from there, so many to each, the first at the offset."""
    rows: list[tuple[int, int, int, int, int]] = []
    left = dict(counts)
    used = dict.fromkeys(counts, 0)
    rooms: list[int] = []  # ascending; each room's sequences are ranges (first, number)
    ranges: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        rows.append((length, used[length], each, first, offset))
        used[length] += n
        left[length] -= n

    def room(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in ranges:
                insort(rooms, space)
                ranges[space] = []
            ranges[space].append((first, n))

    large = sorted(length for length in counts if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and (not left[large[at]] or large[at] == length and left[length] < 2):
                at -= 1
            if at < 0:
                n = left[length]
                put(length, n, 1, opened, 0)
                room(capacity - length, opened, n)
            elif large[at] == length:
                n = left[length] // 2
                put(length, 2 * n, 2, opened, 0)
                room(capacity - 2 * length, opened, n)
            else:
                n = min(left[length], left[large[at]])
                put(length, n, 1, opened, 0)
                put(large[at], n, 1, opened, length)
                room(capacity - length - large[at], opened, n)
            opened += n
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                space, first = capacity, opened
                n = -(-left[length] // (capacity // length))
                opened += n
            else:
                space = rooms[at]
                first, n = ranges[space].pop()
            each = space // length
            full = min(n, left[length] // each)  # sequences that take as many as they can
            if full:
                put(length, full * each, each, first, capacity - space)
                room(space - full * each // full * length, first, full)
            if full < n:
                rest = left[length] if left[length] < each else 0
                if rest:
                    put(length, rest, rest, first + full, capacity - space)
                    room(space - rest * length, first + full, 1)
                    full += 1
                room(space, first + full, n - full)
            if space in ranges and not ranges[space]:
                del ranges[space]
                rooms.remove(space)
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(items: DataFrame, capacity: int, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`items` with `sequence_id` and `offset` (long): sequences hold at most `capacity`, items lie gapless from 0.

    Items that are equal in `keys` are still placed one by one; which of two equal ones comes first is open, and the
    plan does not depend on it. A length that is null, below 1 or above `capacity` is an error. An empty
    table gives an empty table. Columns already named `sequence_id` or `offset` are replaced. `items` is read
    three times, so it should come from a written table.
    """
    checked = F.when(F.col(length).between(1, capacity), F.col(length)).otherwise(
        F.raise_error(F.concat(F.lit("length out of range: "), F.coalesce(F.col(length).cast("string"), F.lit("null"))))
    )
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = items.select(
        F.struct(*kept).alias("item"),  # whatever the input's columns are called
        F.struct(*keys).alias("by"),
        checked.cast("long").alias("size"),
        F.pmod(F.xxhash64(*keys), F.lit(LANES)).cast("int").alias("lane"),
    )
    # ranks of a length are dealt in lanes, so that a length of very many items is ranked by many tasks
    counts = rows.groupBy("size", "lane").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    histogram = {r[0]: r[1] for r in rows.groupBy("size").count().collect()}  # at most `capacity` rows
    shared = items.sparkSession.sparkContext.broadcast(plan(histogram, capacity))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = shared.value
        keys = table[:, 0] * RANKS + table[:, 1]
        for lengths, ranks in batches:
            size, rank = lengths.to_numpy(), ranks.to_numpy()
            row = table[np.searchsorted(keys, size * RANKS + rank, side="right") - 1]
            nth = rank - row[:, 1]
            places = [row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * size]
            yield pa.StructArray.from_arrays([pa.array(x) for x in places], ["sequence_id", "offset"])

    within = Window.partitionBy("size", "lane").orderBy("by")
    ranked = rows.withColumn("nth", F.row_number().over(within)).join(base, ["size", "lane"])
    placed = ranked.withColumn("place", place(F.col("size"), F.col("base") + F.col("nth") - 1))
    return placed.select("item.*", F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from pieces with `sequence_id`, `offset` and binary `ids`. A
    group holds at most one sequence of ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (whole, part) -> concat(whole, part.ids))").alias("ids"))
