"""Importance resampling towards a target: hashed n-gram features, counted and scored by an automaton over known words.

An Aho-Corasick automaton holds words between delimiters, each with its CRC-32 and length. A scan of a text yields these
payloads in order, and the payloads of neighbours compose to the CRC-32 of their n-gram, which is never built. The
automaton holds the words that are frequent in the whole corpus; words between its matches are hashed as they stand, so what it holds
decides speed and nothing else.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.llm.common import worker_state, written

KNOWN = 1 << 15  # words of the automaton, at most
SUMMARY = 1 << 16  # words that a task's summary keeps
LONGEST = 64  # bytes of a word that can be known
CHUNK = 1 << 20  # bytes of text that are scanned together
# Fixed value: a word is a run of a-z, 0-9 and all that is not ASCII, once A-Z are lower-cased.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.encode().translate(LETTERS).split()


# CRC-32 of joined strings: crc(a + b) = advanced(crc(a), len(b)) ^ crc(b)


@cache
def _zeros(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of a CRC-32: four tables of 256, one for each byte of it."""
    if power == 0:
        units = [zlib.crc32(bytes([0]), 1 << bit) ^ zlib.crc32(bytes([0])) for bit in range(32)]
    else:
        units = [int(_apply(_zeros(power - 1), _apply(_zeros(power - 1), np.array([1 << bit], np.uint32)))[0]) for bit in range(32)]
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    tables[byte, value] ^= np.uint32(units[8 * byte + bit])
    return tables


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        tables[0][crc & 255] ^ tables[1][crc >> np.uint32(8) & 255] ^ tables[2][crc >> np.uint32(16) & 255] ^ tables[3][crc >> np.uint32(24)]
    )


def advanced(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The linear part of what `n_bytes` more bytes do to each CRC-32."""
    crc, power = crc.astype(np.uint32), 0
    while (n_bytes >> power).any():
        longer = np.flatnonzero(n_bytes >> power & 1)
        crc[longer] = _apply(_zeros(power), crc[longer])
        power += 1
    return crc


def composed(crc: np.ndarray, n_bytes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(m, the CRC-32 of each run of m neighbours joined by a space) for m from 1 to n."""
    space = np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    runs = crc
    for m in range(1, n + 1):
        if m > 1:
            runs, added, length = runs[:-1], crc[m - 1 :], n_bytes[m - 1 :]
            spaced = advanced(runs, np.broadcast_to(one, runs.shape)) ^ space
            runs = advanced(spaced, length) ^ added
        yield m, runs


class Dictionary:
    """The automaton of known words."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.n_bytes = np.array([len(w) for w in words], np.int64)
        texts = [w.decode() for w in words]
        self.n_chars = np.array([len(t) for t in texts], np.int64)
        self.automaton = ahocorasick.Automaton()
        for number, word in enumerate(texts):
            self.automaton.add_word(f" {word} ", number)
        if texts:
            self.automaton.make_automaton()

    def payloads(self, text: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 and length of every word of `text`, which is its `n_words` words between single spaces, one at each end too."""
        found = list(self.automaton.iter(text)) if len(self.crc) else []
        ends, numbers = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        crc, n_bytes = self.crc[numbers], self.n_bytes[numbers]
        if len(found) == n_words:
            return crc, n_bytes
        # the space before a match is the space behind the word before it; what lies between others is not known
        starts = np.append(ends - self.n_chars[numbers] - 1, len(text) - 1)
        before = np.insert(ends, 0, 0)
        places, others = [], []
        for gap in np.flatnonzero(starts > before).tolist():
            rest = text[before[gap] : starts[gap]].encode().split()
            places += [gap] * len(rest)
            others += rest
        return (
            np.insert(crc, places, np.fromiter(map(zlib.crc32, others), np.uint32, len(others))),
            np.insert(n_bytes, places, np.fromiter(map(len, others), np.int64, len(others))),
        )


def _chunks(texts: Iterator[str | None]) -> Iterator[tuple[str, np.ndarray]]:
    """Texts joined to one of words between single spaces, with the number of words of each."""
    parts, counts, size = [], [], 0
    for text in texts:
        words = words_of(text or "")
        parts += words
        counts.append(len(words))
        size += len(text or "")
        if size >= CHUNK:
            yield f" {b' '.join(parts).decode()} ", np.array(counts)
            parts, counts, size = [], [], 0
    if counts:
        yield f" {b' '.join(parts).decode()} ", np.array(counts)


def _features(dictionary: Dictionary, text: str, counts: np.ndarray, n: int, buckets: int):
    """(document, bucket) of every feature of a chunk."""
    owner = np.repeat(np.arange(len(counts)), counts)
    crc, n_bytes = dictionary.payloads(text, len(owner))
    for m, runs in composed(crc, n_bytes, n):
        first, last = owner[: len(runs)], owner[m - 1 :]
        inside = first == last
        yield first[inside], (runs[inside] % np.uint32(buckets)).astype(np.int64)


def frequent_words(
    texts: DataFrame,
    text: str = "text",
    known: int = KNOWN,
    summary: int = SUMMARY,
    longest: int = LONGEST,
    cut: Callable[[str], list[bytes]] = words_of,
) -> list[bytes]:
    """At most `known` words of at most `longest` bytes that are frequent in all of `texts`; `cut` gives a text's words.

    Every task reads all its words into a summary that keeps at most `summary` of them: when there are twice as many, the
    count of the first one that must go is taken off all (Misra and Gries 1982), which leaves no frequent word out. Summaries are added
    up by word; nothing else is shuffled. Words are taken by bands of counts, an eighth of a power of two each, as long as whole
    bands fit, so that the driver gets `known` words at most, however many tasks there are.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0):
                kept.update(cut(value.as_py() or ""))
                if len(kept) > 2 * summary:
                    off = sorted(kept.values(), reverse=True)[summary]
                    kept = Counter({w: c - off for w, c in kept.items() if c > off})
        most = [(w, c) for w, c in kept.most_common(summary) if 0 < len(w) <= longest]
        for start in range(0, len(most), 8192):
            part = most[start : start + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["word", "n"]
            )

    sums = texts.select(text).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = written(sums.where("n > 1").withColumn("band", F.floor(8 * F.log2("n"))), "words")
    room, least = known, None
    for row in sums.groupBy("band").count().orderBy(F.desc("band")).collect():  # 512 bands at most
        room -= row["count"]
        if room < 0:
            break
        least = row.band
    if least is None:
        return []
    found = sums.where(F.col("band") >= least).select("n", "word").collect()
    return [bytes(row.word) for row in sorted(found, key=lambda row: (-row.n, row.word))]


def _dictionary(words) -> Dictionary:
    return worker_state(("importance", str(hash(tuple(words.value)))), lambda: Dictionary(words.value))


def bucket_counts(texts: DataFrame, words, text: str, n: int, buckets: int) -> np.ndarray:
    """How many features of all `texts` fall in each bucket; `words` is a broadcast list for the automaton."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, sums = _dictionary(words), np.zeros(buckets, np.int64)
        for batch in batches:
            for joined, counts in _chunks(v.as_py() for v in batch.column(0)):
                for _, bucket in _features(dictionary, joined, counts, n, buckets):
                    sums += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], ["bucket", "n"])

    found = texts.select(text).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():  # a row per bucket at most
        out[row.bucket] = row.n
    return out


def gains(of_target: np.ndarray, of_docs: np.ndarray, scale: int = 1000) -> np.ndarray:
    """What one feature of each bucket adds to a weight: the smoothed log ratio of its shares, in units of 1 / scale, rounded down."""
    buckets, t_all, s_all = len(of_docs), int(of_target.sum()), int(of_docs.sum())
    ratio = (of_target + 1.0) * (s_all + buckets) / ((of_docs + 1.0) * (t_all + buckets))
    return np.array([math.floor(scale * math.log(r)) for r in ratio.tolist()], np.int64)


def weighted(docs: DataFrame, words, gain: np.ndarray, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _dictionary(words)
        for batch in batches:
            done = 0
            for joined, counts in _chunks(v.as_py() for v in batch.column(1)):
                n_features, weight = np.zeros((2, len(counts)), np.int64)
                for owner, bucket in _features(dictionary, joined, counts, n, len(gain)):
                    n_features += np.bincount(owner, minlength=len(counts))
                    # sums of whole numbers far below 2 ** 53 are exact
                    weight += np.bincount(owner, gain[bucket], len(counts)).astype(np.int64)
                ids = batch.column(0).slice(done, len(counts))
                done += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(n_features), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        scored, "doc_id long, n_words long, n_features long, weight long"
    )


def _noise(seed: int) -> Column:
    """Gumbel noise from the id alone, in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """`rows` with their place (from 1) in `order`: ranges of rows are sorted each on its own, and follow each other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for row in dealt.groupBy("range").count().orderBy("range").collect():  # a row per range
        offsets.append((row["range"], before))
        before += row["count"]
    ahead = rows.sparkSession.createDataFrame(offsets, "range int, ahead long")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = dealt.withColumn("nth", nth).join(F.broadcast(ahead), "range")
    return placed.withColumn("rank", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "range")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row per document; rank is null where a document is not drawn.

    Features are all runs of 1 to `n` consecutive words, hashed to `buckets`; a document's weight is the sum of its features' `gains`,
    its score the weight and Gumbel noise from `seed` and its id. Of N documents of at least `min_words` words, the floor(percent * N / 100) of the
    highest scores are drawn, ties to the smaller id, which amounts to sampling without replacement by importance.

    A null text has no words, features or weight. Documents without an id share the noise of an empty one and come last in ties; rows that repeat an id
    are documents of their own, in an order of their weight and words. An empty target or corpus counts nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(frequent_words(docs, text))
    gain = gains(
        bucket_counts(target, words, target_text, n, buckets), bucket_counts(docs, words, text, n, buckets)
    )
    scored = weighted(docs, words, gain, doc_id, text, n).withColumn("score", F.col("weight") + _noise(seed))
    # the row number of the written table parts rows that are equal in all else
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = percent * enough.count() // 100
    ranked = _numbered(enough, F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_words", "row")
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest).drop("row")
