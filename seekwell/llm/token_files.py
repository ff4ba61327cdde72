"""Token ids in binary files: one shard per range of document ids, boundaries in Elias-Fano code.

A file, all numbers little-endian:

    magic      8 bytes
    ids        n_ids numbers of `width` bytes, the documents one after the other
    ends       Elias-Fano code of the end of each document in `ids`
    doc_ids    Elias-Fano code of the documents' ids, less the first of them; documents without an id come first and are left out
    footer     eight 64-bit numbers: width, n_docs, n_null_ids, n_ids, first doc_id, bytes of ends, bytes of doc_ids, crc32 of ids

Elias-Fano (Elias 1974, Fano 1971) keeps n ascending numbers below u in about n * (2 + log2(u / n)) bits: the low
bits of each as they are, the high bits as the gaps between ones of a bit vector. Every 256th one's place is kept too, so
that a number is found by a short walk (select) and no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekwell.llm.common import file_system, written

MAGIC = b"SWTOKEN1"
FOOTER = "<8q"
HEAD = "<4q"
EVERY = 256
READ_IDS = 1 << 20
READ_DOCS = 1 << 14


def elias_fano(values: np.ndarray) -> bytes:
    """The code of ascending numbers from 0 on."""
    n = len(values)
    low_bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    samples = ones[::EVERY].astype("<u4" if len(high) <= (1 << 32) - 8 else "<u8")
    parts = [np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()]
    return struct.pack(HEAD, n, low_bits, len(parts[0]), len(parts[1])) + parts[0] + parts[1] + samples.tobytes()


class EliasFano:
    """Reads the code without unpacking it: `self[i]` walks at most over the bytes between two sampled ones."""

    def __init__(self, code: bytes):
        self.n, self.low_bits, low, high = struct.unpack_from(HEAD, code)
        at = struct.calcsize(HEAD)
        self.low = np.frombuffer(code, np.uint8, low, at)
        self.high = np.frombuffer(code, np.uint8, high, at + low)
        self.samples = np.frombuffer(code, "<u4" if high < 1 << 29 else "<u8", offset=at + low + high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The place of the i-th one of the high bits."""
        at = int(self.samples[i // EVERY])
        to_go = i % EVERY
        byte, skip = at // 8, at % 8
        word = int(self.high[byte]) >> skip << skip
        while (ones := word.bit_count()) <= to_go:
            to_go -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(to_go):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        low = chunk >> first % 8 & (1 << self.low_bits) - 1
        return self.select(i) - i << self.low_bits | low

    def between(self, start: int, stop: int) -> np.ndarray:
        """Numbers `start` to `stop`: the first and the last are selected, and only the bits between them are unpacked."""
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = self.select(start), self.select(stop - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : b // 8 + 1], bitorder="little")[a % 8 :])[: stop - start] + a
        values = ones - np.arange(start, stop) << self.low_bits
        first, last = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        for k in range(self.low_bits):
            values |= bits[k :: self.low_bits].astype(np.int64) << k
        return values


def write_token_files(docs: DataFrame, root: str, width: int = 4, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Writes the ids of all `docs` under `root` in ascending order of `doc_id` and returns the table of the files.

    `ids`: a function that adds binary column `ids` (little-endian unsigned 32-bit) to a frame, or the name of such a
    column. A function is applied behind the shuffle, so that texts are moved and not ids, and sampled ranges encode nothing.
    The table (shard, path, n_docs, n_ids, base) has a row per file; `base` counts the ids of all files before it.
    Documents are dealt by ranges of ids; those of equal ids come in the order of their content's hash, those with a null
    id come first. Ids that do not fit `width` bytes (2 or 4) are an error. Each attempt of a task writes a file of its own, and
    the table names those of the attempts that counted. `root` has to be reachable from every executor.
    """
    others = [c for c in docs.columns if c != doc_id]
    tie = F.xxhash64(*others) if others else F.lit(0)
    ranged = docs.withColumn("_tie", tie).repartitionByRange(F.asc_nulls_first(doc_id), "_tie")
    ranged = ranged.sortWithinPartitions(F.asc_nulls_first(doc_id), "_tie").drop("_tie")
    ordered = (ids(ranged) if callable(ids) else ranged.withColumn("ids", F.col(ids))).select(F.col(doc_id).cast("long"), "ids")
    kind = {2: "<u2", 4: "<u4"}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4()}.tok"
        doc_ids, sizes, crc, out = [], [], 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                out = fs.open_output_stream(path)
                out.write(MAGIC)
            for value in batch.column(1):
                raw = np.frombuffer(value.as_py() or b"", "<u4")
                sizes.append(len(raw))
                if width == 2:
                    if len(raw) and raw.max() >= 1 << 16:
                        raise ValueError("an id does not fit two bytes")
                    raw = raw.astype(kind)
                data = raw.tobytes()
                crc = zlib.crc32(data, crc)
                out.write(data)
            doc_ids.append(batch.column(0))
        if out is None:
            return
        column = pa.chunked_array(doc_ids, pa.int64()).combine_chunks()
        known = column.drop_null().to_numpy()
        first = int(known[0]) if len(known) else 0
        ends, names = elias_fano(np.cumsum(sizes)), elias_fano(known - first)
        n_ids = int(sum(sizes))
        out.write(ends + names + struct.pack(FOOTER, width, len(column), column.null_count, n_ids, first, len(ends), len(names), crc))
        out.close()
        row = {"shard": [shard], "path": [path], "n_docs": [len(column)], "n_ids": [n_ids]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    files = written(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of a table as `write_token_files` returns it.

    `start` counts the ids of all documents before it, `ids` is binary, little-endian unsigned 32-bit. A file whose ids do not
    have the checksum of its footer is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    yield from _documents(f, base)

    schema = "doc_id long, start long, n_tokens long, ids binary"
    dealt = files.repartitionById(max(1, files.count()), "shard")
    return dealt.select("path", "base").mapInArrow(read, schema)


def _documents(f, base: int) -> Iterator[pa.RecordBatch]:
    f.seek(f.size() - struct.calcsize(FOOTER))
    width, n_docs, n_null, n_ids, first, n_ends, n_names, crc = struct.unpack(FOOTER, f.read())
    f.seek(len(MAGIC) + n_ids * width)
    ends, names = EliasFano(f.read(n_ends)), EliasFano(f.read(n_names))
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    seen, at, start = 0, 0, 0
    while at < n_docs:
        # the documents of the next block are found by selects; no table of all offsets is made
        to = max(at + 1, min(at + READ_DOCS, bisect_right(ends, start + READ_IDS, lo=at)))
        stops = ends.between(at, to)
        data = f.read(int(stops[-1] - start) * width)
        seen = zlib.crc32(data, seen)
        ids = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
        starts = np.concatenate([[start], stops[:-1]])
        cuts = (4 * (np.append(starts, stops[-1]) - start)).tolist()
        rows = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        no_name = max(0, min(to, n_null) - at)
        known = names.between(max(at, n_null) - n_null, max(to, n_null) - n_null) + first
        named = pa.concat_arrays([pa.nulls(no_name, pa.int64()), pa.array(known, pa.int64())])
        columns = [named, pa.array(starts + base), pa.array(stops - starts), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
        at, start = to, int(stops[-1])
    if seen != crc:
        raise ValueError("the ids of a token file are damaged")
