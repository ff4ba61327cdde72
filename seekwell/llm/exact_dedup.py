"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each part of the input (the documents of a task) sorts the 64-bit fingerprints of its normalised texts and sends every
owner of a range of fingerprints its share, each value once, as Golomb-Rice coded differences. An owner answers each part
with a bitmap of the values that another part has too. Only documents so marked, or met twice in their own
part, are suspects: their texts alone are shuffled, and grouped by all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import tidy, written
from seekwell.operators.joins import join_facts

# The characters that a normalised text leaves out, x20 and x09 to x0D.
BLANKS = " \t\n\v\f\r"
BROADCAST_IDS = 1 << 20
PART = "part long, doc_ids binary, sizes binary, digests binary, places binary, sent array<struct<owner: int, code: binary>>"


def golomb(values: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending unsigned numbers: quotients of the differences in unary, then their remainders."""
    deltas = np.diff(values, prepend=np.uint64(0))
    width = max(0, int(deltas.mean()).bit_length() - 1) if len(deltas) else 0
    quotients = (deltas >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (deltas[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(values), width, len(unary)], "<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_values(code: bytes) -> np.ndarray:
    n, width, n_unary = np.frombuffer(code, "<u4", 3).tolist()
    n_bytes = -(-n_unary // 8)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, n_bytes, 12), count=n_unary)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=12 + n_bytes), count=n * width).reshape(n, width)
    deltas = quotients.astype(np.uint64) << np.uint64(width)
    for i in range(width):
        deltas |= rest[:, i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(deltas, dtype=np.uint64)


def _parts(owners: int):
    """One row for all documents of a task, in order of their fingerprints, with a message to each owner."""
    share = -(-(1 << 64) // owners)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids, sizes, digests, prints = [], [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            sizes.append(batch.column(1).to_numpy())
            for text in batch.column(2):
                bare = (text.as_py() or b"").translate(None, BLANKS.encode())
                digests.append(hashlib.sha256(bare).digest())
                prints.append(xxhash.xxh3_64_intdigest(bare))
        if not prints:
            return
        all_prints = np.array(prints, np.uint64)
        order = np.argsort(all_prints, kind="stable")
        values, places = np.unique(all_prints[order], return_inverse=True)
        cuts = np.searchsorted(values, np.array([min(i * share, (1 << 64) - 1) for i in range(1, owners)], np.uint64))
        sent = [
            {"owner": i, "code": golomb(own - np.uint64(i * share))}
            for i, own in enumerate(np.split(values, cuts))
            if len(own)
        ]
        row = {
            "part": [TaskContext.get().partitionId()],
            "doc_ids": [np.concatenate(ids)[order].astype("<i8").tobytes()],
            "sizes": [np.concatenate(sizes)[order].astype("<i8").tobytes()],
            "digests": [b"".join(map(digests.__getitem__, order.tolist()))],
            "places": [places.astype("<u4").tobytes()],
            "sent": [sent],
        }
        kinds = pa.struct([("owner", pa.int32()), ("code", pa.binary())])
        types = [pa.int64(), *[pa.binary()] * 4, pa.list_(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], list(row))

    return part


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (owner, part, code), sorted by owner, to (part, owner, bitmap): which of the part's values others have too."""

    def answer(owner: int, parts: list[int], codes: list[bytes]) -> pa.RecordBatch:
        lists = [golomb_values(c) for c in codes]
        _, places, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = np.split(times[places] > 1, np.cumsum([len(x) for x in lists])[:-1])
        bitmaps = [np.packbits(s).tobytes() for s in shared]
        sizes = pa.array([len(x) for x in lists], pa.int32())
        columns = [pa.array(parts, pa.int64()), pa.array([owner] * len(parts), pa.int32()), sizes, pa.array(bitmaps, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "owner", "n", "bitmap"])

    owner, parts, codes = None, [], []
    for batch in batches:
        for now, part, code in zip(*(c.to_pylist() for c in batch.columns)):
            if now != owner and codes:
                yield answer(owner, parts, codes)
                parts, codes = [], []
            owner = now
            parts.append(part)
            codes.append(code)
    if codes:
        yield answer(owner, parts, codes)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their bitmaps, in order of owners, to a row per document."""
    for batch in batches:
        for row in batch.to_pylist():
            bits = [np.unpackbits(np.frombuffer(a["bitmap"], np.uint8), count=a["n"]) for a in row["answers"]]
            places = np.frombuffer(row["places"], "<u4")
            suspect = (np.concatenate(bits) > 0) | (np.bincount(places) > 1)
            digests = row["digests"].hex()
            columns = [
                pa.array(np.frombuffer(row["doc_ids"], "<i8")),
                pa.array(np.frombuffer(row["sizes"], "<i8")),
                pa.array([digests[i : i + 64] for i in range(0, len(digests), 64)], pa.string()),
                pa.array(suspect[places]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "text_sha256", "suspect"])


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document.

    Texts are equal when they are after deletion of every character of `BLANKS`; a null text is empty, and empty or
    blank texts are equal. Of equal texts the one with the most code points stays, then that of the smallest `doc_id`.
    `text_sha256` is of the normalised text in UTF-8. Rows that share both `doc_id` and text are each counted in
    `group_size` and have the same answer. A row without `doc_id` cannot be named as kept: it is in no group, its
    `keep_id` and `group_size` are null, and it is kept. An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    named, owners = rows.where("doc_id is not null"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = named.select("doc_id", "n_chars", F.col("text").cast("binary").alias("text"))
    parts = written(coded.mapInArrow(tidy(_parts(owners)), PART), "parts")
    sent = parts.select("part", F.explode("sent").alias("to")).select("to.owner", "part", "to.code")
    dealt = sent.repartitionById(owners, "owner").sortWithinPartitions("owner", "part")
    answers = dealt.mapInArrow(tidy(_answer), "part long, owner int, n int, bitmap binary")
    per_part = answers.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("owner", "n", "bitmap"))).alias("answers"))
    marked = parts.join(per_part, "part").select("doc_ids", "sizes", "digests", "places", "answers")
    facts = written(
        marked.mapInArrow(tidy(_marked), "doc_id long, n_chars long, text_sha256 string, suspect boolean"), "facts"
    )
    # the suspects' bytes: copies of a task are collapsed before they are moved
    suspects = written(facts.where("suspect").select("doc_id").distinct(), "suspects")
    if suspects.count() <= BROADCAST_IDS:  # then no other text is moved to find them
        suspects = F.broadcast(suspects)
    bare = F.col("text")
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    equal = named.join(suspects, "doc_id", "left_semi").select("doc_id", "n_chars", bare.alias("bare"))
    equal = equal.groupBy("bare", "n_chars").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    lengths = equal.select(F.sha2("bare", 256).alias("text_sha256"), "n_chars", "doc_id", "n")
    first = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus"))).alias("first")
    groups = lengths.groupBy("text_sha256").agg(first, F.sum("n").alias("group_size"))
    groups = groups.select("text_sha256", (-F.col("first.minus")).alias("keep_id"), "group_size")
    labelled = join_facts(facts, written(groups, "groups"), "text_sha256", "group_size", F.col("doc_id"))
    keep = F.coalesce("keep_id", "doc_id")
    result = labelled.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep == F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
    unnamed = rows.where("doc_id is null").select(
        "doc_id",
        F.lit(None).cast("long").alias("keep_id"),
        F.lit(None).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.sha2(F.translate("text", BLANKS, ""), 256).alias("text_sha256"),
    )
    return result.unionAll(unnamed)
