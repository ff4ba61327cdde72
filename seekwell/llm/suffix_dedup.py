"""Removal of byte strings that occurred before, found with a logarithmic family of suffix arrays.

Any two equal strings of `length` bytes have the same anchor: the place in them whose `GRAM` bytes hash least. So a text is cut
into phrases, the runs of strings with one anchor, each with all bytes of its strings; equal strings lie in phrases
whose anchors have equal bytes. That tells, from 16 bytes of hashes per phrase, what need not be looked at:

1. Each part of the input (the documents of a task) keeps its texts in a file in the shared folder and sends the hashes of
   its phrases to the owners of ranges of anchors. An owner answers: a phrase met nowhere else and of an anchor met nowhere else is
   clear; one met before is removed whole; the first of several different phrases on one anchor has to be compared.
2. The bytes of those last phrases go, by anchor, to the indexes. An index takes them in order, in batches. A batch
   gets a suffix array: the starts of its strings, sorted so that equal prefixes of `length` bytes lie together. The
   array is merge-scanned against those of all levels, and against itself; matches are verified on the bytes. What is new becomes a
   level, and levels of about one size are merged, so that there are at most about log(n) of them.
3. The answers go back to the parts, which cut their texts.

Arrays are ordered by a 64-bit hash of the prefix in place of its bytes: matches of `length` bytes ask for equal
prefixes only, and numbers sort and merge many times faster.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekwell.llm.common import file_system, fresh_folder, small, tidy, worker_state, written

GRAM = 32
PIECE = 1 << 20  # bytes of a text that are looked at together, at most
GROUP = 1 << 18  # bytes of short texts that are
STORED_ROWS = 512  # rows of a part's file that are written and read together
HASHED = 1 << 17  # strings that are hashed together
BATCH = 1 << 21  # bytes of a new suffix array
LATEST = (1 << 63) - 1
FILE, OWN, SENT, COVER, ASK = range(5)  # kinds of message
MESSAGE = "owner int, part int, kind int, path string, payload binary"
RECORD = np.dtype([("key", "<u8"), ("digest", "<u8"), ("doc_id", "<i8"), ("row", "<u4"), ("start", "<u4"), ("n", "<u2")])
SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])
QUESTION = np.dtype([("key", "<u8"), ("row", "<u4"), ("start", "<u4"), ("n", "<u2")])
MULTIPLIER = 0x9E3779B97F4A7C15


def planes(records: np.ndarray) -> bytes:
    """Records with all first bytes together, then all second bytes and so on, which packs well."""
    return np.ascontiguousarray(records.view(np.uint8).reshape(len(records), records.itemsize).T).tobytes()


def unplanes(data: bytes, kind: np.dtype) -> np.ndarray:
    size = len(data) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, len(data)).reshape(kind.itemsize, size).T).view(kind).ravel()


def rolling(data: np.ndarray, size: int, kind: type) -> np.ndarray:
    """A hash of the `size` bytes from each place on, by doubling; one value fewer than places for each missing byte."""
    step, done, bits = MULTIPLIER | 1, 1, np.dtype(kind).itemsize * 8
    h, out, out_size = data.astype(kind), None, 0
    while True:
        if size & done:
            if out is None:
                out, out_size = h, done
            else:  # out's bytes come first
                shifted = h[out_size:]
                m = min(len(out), len(shifted))
                out = out[:m] * kind(pow(step, done, 1 << bits)) + shifted[:m]
                out_size += done
        if out_size == size:
            return out[: max(0, len(data) - size + 1)]
        h = h[:-done] * kind(pow(step, done, 1 << bits)) + h[done:] if len(h) > done else h[:0]
        done *= 2


def phrases(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in `data`: per phrase its text, first and last string's start, and anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = rolling(data, GRAM, np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    window, done = length - GRAM + 1, 1
    while 2 * done <= window:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < window:
        least = np.minimum(least[: len(least) - (window - done)], least[window - done :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    if not len(start):
        return none, none, none, none
    a, t = anchor[start], text[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    return t[first], start[first], start[last], a[first]


def _pieces(rows: Iterator[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as (row, offset, bytes) in groups of about `GROUP` bytes; one longer than `PIECE` goes in several, overlapping
    so that each string of it lies in exactly one."""
    group, size = [], 0
    for row, text in rows:
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[offset : offset + PIECE + length - 1]
            group.append((row, offset, piece))
            size += len(piece)
            if size >= GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def _records(group: list[tuple[int, int, bytes]], doc_ids: list[int], length: int) -> np.ndarray:
    import xxhash

    joined = b"".join(piece for _, _, piece in group)
    ends = np.cumsum([len(piece) for _, _, piece in group])
    text, first, last, anchor = phrases(np.frombuffer(joined, np.uint8), ends, length)
    records = np.empty(len(text), RECORD)
    key, digest = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
    records["key"] = [key(joined[a : a + GRAM]) for a in anchor.tolist()]
    records["digest"] = [digest(joined[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]
    rows, offsets = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    begins = np.concatenate([[0], ends[:-1]])
    records["row"] = rows[text]
    records["doc_id"] = np.array([doc_ids[r] for r in rows.tolist()], np.int64)[text]
    records["start"] = first - begins[text] + offsets[text]
    records["n"] = last - first + 1
    return records


def in_order(records: np.ndarray, *by: str) -> np.ndarray:
    return records[np.lexsort([records[name] for name in reversed(by)])]


def spans_of(records: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    out["row"], out["start"] = records["row"], records["start"]
    out["end"] = records["start"] + (records["n"].astype(np.uint32) + np.uint32(length - 1))
    return out


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """The maximal runs that spans cover together, in order of rows."""
    if not len(spans):
        return spans
    spans = in_order(spans, "row", "start")
    reach = spans["row"].astype(np.int64) << 32 | spans["end"]
    reach = np.maximum.accumulate(reach)
    start = spans["row"].astype(np.int64) << 32 | spans["start"]
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    out = spans[new]
    out["end"] = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])] & 0xFFFFFFFF
    return out


def message(owner: int, part: int, kind: int, path: str | None, payload: bytes) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    values = ([owner], [part], [kind], [path], [payload])
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["owner", "part", "kind", "path", "payload"])


def _send(root: str, owners: int, length: int):
    """Documents to messages: the part's file, the copies within the part, and each owner's phrases."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("suffix dedup",), bool)  # drops what other operators have kept
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        part, path = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4()}.arrow"
        doc_ids: list[int] = []
        found: list[np.ndarray] = []
        out = file = None
        for batch in batches:
            if file is None:
                out = fs.open_output_stream(path)
                file = pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            for at in range(0, batch.num_rows, STORED_ROWS):
                file.write_batch(batch.slice(at, STORED_ROWS))
            first = len(doc_ids)
            doc_ids += [LATEST if d is None else d for d in batch.column(0).to_pylist()]
            rows = ((first + i, t.as_py() or b"") for i, t in enumerate(batch.column(1)))
            found += [_records(group, doc_ids, length) for group in _pieces(rows, length)]
        if file is None:
            return
        file.close()
        out.close()
        yield message(part % owners, part, FILE, path, b"")
        records = np.concatenate(found) if found else np.zeros(0, RECORD)
        found.clear()
        records = in_order(records, "key", "digest", "doc_id", "row", "start")
        again = np.zeros(len(records), bool)
        again[1:] = (records["key"][1:] == records["key"][:-1]) & (records["digest"][1:] == records["digest"][:-1])
        yield message(part % owners, part, OWN, None, planes(joined_spans(spans_of(records[again], length))))
        records = records[~again]
        bounds = np.array([(i << 64) // owners for i in range(1, owners)], np.uint64)
        for owner, own in enumerate(np.split(records, np.searchsorted(records["key"], bounds))):
            if len(own):
                yield message(owner, part, SENT, None, planes(own))

    return send


def _judge(length: int):
    """An owner's messages, sorted by owner, to the answers for each part. Messages that are not for it go through."""

    def answers(owner: int, parts: list[int], sent: list[bytes]) -> Iterator[pa.RecordBatch]:
        lists = [unplanes(s, RECORD) for s in sent]
        records = np.concatenate(lists)
        part = np.repeat(parts, [len(x) for x in lists])
        del lists
        order = np.lexsort([records["start"], records["row"], part, records["doc_id"], records["digest"], records["key"]])
        records, part = records[order], part[order]
        same_key = records["key"][1:] == records["key"][:-1]
        again = np.concatenate([[False], same_key & (records["digest"][1:] == records["digest"][:-1])])
        # the first of each phrase has to be compared where its anchor has another phrase too
        group = np.concatenate([[0], np.cumsum(~same_key)])
        asked = ~again & (np.bincount(group[~again], minlength=group[-1] + 1)[group] > 1)
        for kind, mask in ((COVER, again), (ASK, asked)):
            mine, own = part[mask], records[mask]
            for p in np.unique(mine).tolist():
                some = own[mine == p]
                if kind == COVER:
                    yield message(owner, p, COVER, None, planes(joined_spans(spans_of(some, length))))
                else:
                    ask = np.empty(len(some), QUESTION)
                    for name in QUESTION.names:
                        ask[name] = some[name]
                    yield message(owner, p, ASK, None, planes(ask))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, sent = None, [], []
        for batch in batches:
            for owner, part, kind, path, payload in zip(*(batch.column(i) for i in range(5))):
                owner, part, kind = owner.as_py(), part.as_py(), kind.as_py()
                if kind != SENT:
                    yield message(owner, part, kind, path.as_py(), payload.as_py())
                    continue
                if owner != now and sent:
                    yield from answers(now, parts, sent)
                    parts, sent = [], []
                now = owner
                parts.append(part)
                sent.append(payload.as_py())
        if sent:
            yield from answers(now, parts, sent)

    return judge


def _by_part(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, dict[int, list[bytes]]]]:
    """Messages (part, kind, path, payload), sorted by part, gathered: part, its file, payloads by kind."""
    now, path, kept = None, None, {}
    for batch in batches:
        for part, kind, name, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    yield now, path, kept
                now, path, kept = part, None, {}
            path = name or path
            kept.setdefault(kind, []).append(payload)
    if now is not None:
        yield now, path, kept


def _stored(root: str, path: str) -> Iterator[pa.RecordBatch]:
    fs, _ = file_system(root)
    with fs.open_input_file(path) as f, pa.ipc.open_stream(f) as stream:
        yield from stream


def _fetch(root: str, length: int):
    """Questions of each part to the bytes of their phrases."""
    schema = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("start", pa.int64()), ("phrase", pa.binary())]
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, path, kept in _by_part(root, batches):
            if ASK not in kept:
                continue
            asks = in_order(np.concatenate([unplanes(p, QUESTION) for p in kept[ASK]]), "row", "start")
            cuts = np.searchsorted(asks["row"], np.arange(int(asks["row"][-1]) + 2))
            out: list[tuple] = []
            texts = ((d.as_py(), t.as_py() or b"") for batch in _stored(root, path) for d, t in zip(batch.column(0), batch.column(1)))
            for row, (doc_id, text) in enumerate(texts):
                if row >= len(cuts) - 1:
                    break
                own = asks[cuts[row] : cuts[row + 1]]
                starts = own["start"].tolist()
                for key, a, n in zip(own["key"].view(np.int64).tolist(), starts, own["n"].tolist()):
                    out.append((key, LATEST if doc_id is None else doc_id, part, row, a, text[a : a + n + length - 1]))
                if len(out) >= 20000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return fetch


class SuffixIndex:
    """Suffix arrays of all strings of `length` bytes met so far, in levels of geometrically growing size."""

    def __init__(self, length: int):
        self.length = length
        self.data = bytearray()  # new strings' bytes, one batch behind the other
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # hashes of prefixes, ascending; starts in data
        self.odd: set[bytes] = set()  # strings whose hash another string has too

    def strings(self, starts: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.data, np.uint8), self.length)
        return rows[starts]

    def add(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text, which of its strings have come before: in earlier batches, in an earlier text, or earlier in it."""
        base = len(self.data)
        self.data += b"".join(texts)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - self.length + 1, 0)
        if not counts.sum():
            return [np.zeros(0, bool)] * len(texts)
        local = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        hashes = np.empty(len(local), np.uint64)
        for at in range(0, len(local), HASHED):
            some = local[at : at + HASHED]
            near = np.frombuffer(self.data, np.uint8)[base + some[0] : base + some[-1] + self.length]
            hashes[at : at + HASHED] = rolling(near, self.length, np.uint64)[some - some[0]]
        sorting = np.argsort(hashes, kind="stable")
        array, starts = hashes[sorting], local[sorting] + base
        seen = np.zeros(len(array), bool)
        first = np.concatenate([[True], array[1:] != array[:-1]])
        like = np.arange(len(array))[first][np.cumsum(first) - 1]  # the first of this batch with that hash
        twin = np.where(first, -1, starts[like])
        for level, places in self.levels:
            at = np.minimum(np.searchsorted(level, array), len(level) - 1)
            met = level[at] == array
            twin[met] = places[at[met]]
        odd = []
        pairs = np.flatnonzero(twin >= 0)
        for some in np.array_split(pairs, max(1, len(pairs) // 20000)):
            equal = (self.strings(starts[some]) == self.strings(twin[some])).all(axis=1)
            seen[some[equal]] = True
            odd += some[~equal].tolist()
        for i in sorted(odd, key=lambda i: starts[i]):
            string = bytes(self.data[starts[i] : starts[i] + self.length])
            seen[i] = string in self.odd
            self.odd.add(string)
        new = ~seen
        new[odd] = False
        self.levels.append((array[new], starts[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(-2), self.levels.pop()
            both = np.concatenate([a, b])
            order = np.argsort(both, kind="stable")  # two ascending runs: a merge
            self.levels.append((both[order], np.concatenate([x, y])[order]))
        self.levels = [lv for lv in self.levels if len(lv[0])]
        back = np.empty(len(seen), bool)
        back[sorting] = seen
        return np.split(back, np.cumsum(counts)[:-1])


def _index(length: int):
    """Phrases, in order of documents, to messages with the spans of strings that came before."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, texts, where, size = SuffixIndex(length), [], [], 0
        spans: dict[int, list[tuple[int, int, int]]] = {}

        def compare() -> None:
            for (part, row, start), seen in zip(where, family.add(texts)):
                edges = np.flatnonzero(np.diff(seen.astype(np.int8), prepend=0, append=0)).tolist()
                for a, b in zip(edges[::2], edges[1::2]):
                    spans.setdefault(part, []).append((row, start + a, start + b + length - 1))

        for batch in batches:
            for part, row, start, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                texts.append(phrase)
                where.append((part, row, start))
                size += len(phrase)
                if size >= BATCH:
                    compare()
                    texts, where, size = [], [], 0
        if texts:
            compare()
        for part, found in spans.items():
            yield message(0, part, COVER, None, planes(joined_spans(np.array(found, SPAN))))

    return index


def _cut(root: str):
    """Each part's spans to its documents, with what is left of their bytes and their other columns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, kept in _by_part(root, batches):
            spans = joined_spans(np.concatenate([unplanes(p, SPAN) for kind in (OWN, COVER) for p in kept.get(kind, [])]))
            rows, at, row = spans["row"].tolist(), 0, 0
            starts, ends = spans["start"].tolist(), spans["end"].tolist()
            for batch in _stored(root, path):
                sizes, removed, runs, rest = [], [], [], []
                for text in batch.column(1):
                    data, begin, left, first, gone = text.as_py() or b"", 0, [], at, 0
                    while at < len(rows) and rows[at] == row:
                        left.append(data[begin : starts[at]])
                        begin = ends[at]
                        gone += ends[at] - starts[at]
                        at += 1
                    left.append(data[begin:])
                    sizes.append(len(data))
                    removed.append(gone)
                    runs.append(at - first)
                    rest.append(b"".join(left))
                    row += 1
                counts = [pa.array(c, pa.int64()) for c in (sizes, removed, runs)]
                columns = [batch.column(0), *counts, pa.array(rest, pa.binary()), *batch.columns[2:]]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *batch.schema.names[2:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def remove_repeats(
    docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", others: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document without the bytes of strings that occurred before.

    Columns named in `others` come along; one named like a column of the result is an error.

    A byte goes if a string of `length` bytes (at least 2 * 32) that covers it also starts earlier: in a document of smaller
    `doc_id`, or earlier in its own. Overlaps count; strings are judged on the input, not on what is left; no
    string crosses documents. `kept` (binary) is what remains of the text in UTF-8, and may tear a character; `n_spans`
    counts the maximal runs removed. A null text is empty. Documents with a null `doc_id` come last in
    order; those of equal ids in order of the splits they are read in. An empty table gives an empty table.

    Where one anchor has very many different phrases, as at the edges of a passage that many documents share, one owner
    has their hashes (38 bytes a document) and one index their bytes.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings have to be of {2 * GRAM} bytes at least")
    spark = docs.sparkSession
    root, owners = fresh_folder(spark, "parts"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), *others)
    result = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept", T.BinaryType()), *(rows.schema[c] for c in others)]
    )
    if len(set(result.names)) < len(result):
        raise ValueError("a column to come along has the name of a column of the result")
    sent = rows.mapInArrow(tidy(_send(root, owners, length)), MESSAGE)
    dealt = sent.repartitionById(owners, "owner").sortWithinPartitions("owner", "part")
    answers = written(dealt.mapInArrow(tidy(_judge(length)), MESSAGE), "answers").select("part", "kind", "path", "payload")
    # messages are small and what they stand for is not: a task for each part, which AQE leaves alone
    parts = (answers.agg(F.max("part")).first()[0] or 0) + 1
    asked = answers.where(F.col("kind").isin(FILE, ASK)).repartitionById(parts, "part").sortWithinPartitions("part")
    phrase = asked.mapInArrow(tidy(_fetch(root, length)), "key long, doc_id long, part int, row long, start long, phrase binary")
    ordered = phrase.repartition("key").sortWithinPartitions("doc_id", "part", "row", "start").select("part", "row", "start", "phrase")
    compared = ordered.mapInArrow(tidy(_index(length)), MESSAGE).select("part", "kind", "path", "payload")
    all_spans = answers.where(F.col("kind") != ASK).unionAll(compared).repartitionById(parts, "part").sortWithinPartitions("part")
    return all_spans.mapInArrow(tidy(_cut(root)), result)


def whole_characters(kept: Column) -> Column:
    """The text of UTF-8 bytes, without those of characters that a cut has torn."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in small(batches):
            yield pa.array([(k.as_py() or b"").decode("utf-8", "ignore") for k in column], pa.string())

    return decode(kept)
