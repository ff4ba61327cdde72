"""Quality scores of texts: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are runs of one to three words and runs of one to three word shapes: a shape keeps how a word is written (case,
digits, the signs in it) and not what it says, and a word equal to the one before it has a shape of its own. All
are hashed into one weight vector; each counts by its share in the text, so a score is a sparse dot product.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import small, tidy, worker_state

BITS = 18
SIZE = 1 << BITS
SCALE = 8.0  # of the shares, so that the learning rate suits values around one
SAMPLE_ROWS = 16384
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01
FOLDS = 5
CACHE_WORDS = 100_000
LONGEST_KEPT = 48
RUNS = re.compile(r"(.)\1+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SAME = 1
LONGEST_RUN = 3


def shape(word: str) -> str:
    """A for an upper-case letter, a for another, 0 for a digit, signs as they are; runs of one kind once, of signs twice."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUNS.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)


class Features(dict):
    """Word -> hashes of the word and of its shape, in one number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        text = word.decode("utf-8", "replace")
        both = xxhash.xxh32_intdigest(text.lower()) << 32 | xxhash.xxh32_intdigest(shape(text))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = both
        return both

    def of(self, text: bytes) -> tuple[np.ndarray, int]:
        """Places in the weight vector, with repeats, and the number of words."""
        words = text.split()
        both = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        shapes = both & np.uint64(0xFFFFFFFF)
        shapes[1:][both[1:] == both[:-1]] = SAME
        hashes = both >> np.uint64(32)
        places = [hashes & np.uint64(SIZE - 1)]  # single words
        for own, first in ((hashes + np.uint64(1) << np.uint64(32), 2), (shapes, 1)):
            run = own * MIX
            for n in range(1, LONGEST_RUN + 1):
                if n > 1:
                    run = (run[:-1] ^ own[n - 1 :]) * MIX
                if n >= first:
                    places.append(run >> np.uint64(64 - BITS))
        return np.concatenate(places).astype(np.int64), len(words)


def score(weights: np.ndarray, bias: float, places: np.ndarray, words: int) -> float:
    total = bias + (float(weights[places].sum(dtype=np.float64)) * SCALE / words if words else 0.0)
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(rows: Iterable[tuple[np.ndarray, int, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (places, words, label), by FTRL-Proximal (McMahan et al. 2013). Without rows all are 0."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    places, shares, ends, labels = array("i"), array("f"), [0], []  # all rows in two stretches of memory
    for own, words, label in rows:
        own, times = np.unique(own, return_counts=True)
        places.frombytes(np.append(own, SIZE).astype(np.int32).tobytes())
        shares.frombytes(np.append(times * (SCALE / max(words, 1)), 1.0).astype(np.float32).tobytes())
        ends.append(len(places))
        labels.append(label)
    places, shares = np.frombuffer(places, np.int32), np.frombuffer(shares, np.float32)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, pull / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for a, b, label in zip(ends, ends[1:], labels):
            own, values = places[a:b], shares[a:b].astype(np.float64)
            w = weights(z[own], n[own])
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            more = n[own] + g * g
            z[own] += g - (np.sqrt(more) - np.sqrt(n[own])) / ALPHA * w
            n[own] = more
    w = weights(z, n)
    return w[:SIZE], float(w[SIZE])


def fold(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo `FOLDS`; fold 0 is held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS, text: str = "text", doc_id: str = "doc_id"):
    """Weights (little-endian 32-bit floats) and bias, learnt from labelled documents outside fold 0.

    At most `max_rows` labels are used, those whose ids have the smallest hashes: a bounded sample, trained by one
    task. Labels and ids that are null are passed over. Without labels the weights are 0.
    """
    labelled = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null")
    labelled = labelled.where(fold(F.col("doc_id")) != 0).withColumn("place", F.xxhash64("doc_id"))
    sample = labelled.orderBy("place", "doc_id", "label").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").repartition(1).sortWithinPartitions("place", "doc_id", "label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = worker_state(("quality", "features"), Features)
        rows = ((t.as_py() or b"", int(y > 0)) for b in batches for t, y in zip(b.column(0), b.column(1).to_pylist()))
        weights, bias = train((*features.of(text), label) for text, label in rows)
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    found = rows.select("text", "label").mapInArrow(tidy(learn), "weights binary, bias double").first()
    return tuple(found) if found else (np.zeros(SIZE, "<f4").tobytes(), 0.0)


def quality(docs: DataFrame, model: tuple[bytes, float], text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of each whole `text` in column `out` (0 to 1, higher for label 1).

    Only the text counts. A null, empty or blank text has the score of the bias. Other columns stay, one already named
    `out` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vector of fixed size

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = np.frombuffer(shared.value[0], "<f4"), shared.value[1]
        features = worker_state(("quality", "features"), Features)
        for column in small(batches):
            yield pa.array([score(weights, bias, *features.of(t.as_py() or b"")) for t in column.cast(pa.binary())], pa.float64())

    return docs.withColumn(out, scores(F.col(text)))
