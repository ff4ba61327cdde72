"""Token counts of whole texts, as a SentencePiece model gives them, without encoding most of the text.

A pre-token is a run of spaces and the characters up to the next space. Where no piece of the model holds a
space mark behind another character, no merge crosses the start of a pre-token, and the counts of pre-tokens add up
to the count of the text. Two tiers answer for a pre-token: a broadcast table of the frequent ones, then a cache
of the worker; only what both miss is encoded. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import file_bytes, small, texts_of, worker_state
from seekwell.llm.importance import frequent_words

MARK = "▁"  # how SentencePiece writes a space
TABLE_WORDS = 1 << 16
SUMMARY_WORDS = 1 << 16  # of a task, while it counts
LONGEST_KEPT = 48
CACHE_WORDS = 600_000
UNITS = re.compile("( *)([^ ]+)")


def load(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError("pieces of this model cross spaces; its counts do not add up by pre-token")
    if "".join(processor.encode("ﬁ  a", out_type=str)) != f"{MARK}ﬁ{MARK}{MARK}a":
        raise ValueError("this model rewrites its input; its counts do not add up by pre-token")
    return processor


class Counts(dict):
    """Pre-token -> number of tokens. What the table misses is looked up in the worker's cache, then encoded.

    The first space before a pre-token is implied, as the model puts one before every text.
    """

    def __init__(self, table: dict[str, int], processor, cache: dict[str, int]):
        super().__init__(table)
        self.processor = processor
        self.cache = cache

    def __missing__(self, unit: str) -> int:
        n = self.cache.get(unit)
        if n is None:
            n = len(self.processor.encode(unit))
            if len(unit) <= LONGEST_KEPT:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[unit] = n
        return n

    def of(self, text: str) -> int:
        if MARK in text:
            text = text.replace(MARK, " ")
        if not text:
            return 0
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        body = text.rstrip(" ")
        if not body:
            return len(self.processor.encode(text))
        n, first = 0, True
        for spaces, word in UNITS.findall(body):
            n += self[(spaces if first else spaces[1:]) + word]
            first = False
        if tail := len(text) - len(body):
            n += len(self.processor.encode("a" + " " * tail)) - len(self.processor.encode("a"))
        return n


def pre_tokens(text: str) -> list[bytes]:
    """What lies between single spaces of a text, as the table has it."""
    return text.replace(MARK, " ").encode().split(b" ")


def count_tokens(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens of each whole `text` in column `out` (long).

    Equal to `len(SentencePieceProcessor(model_file=model).encode(text))`: no begin, end or added special tokens, and
    strings that look special are ordinary text. A null or empty text has 0 tokens. Other columns stay as
    they are, and a column already named `out` is replaced. An empty table gives an empty table.
    """
    proto = file_bytes(model)
    processor = load(proto)
    found = frequent_words(docs, text, TABLE_WORDS, SUMMARY_WORDS, LONGEST_KEPT, pre_tokens)
    words = [w.decode() for w in found]
    table = {w: len(ids) for w, ids in zip(words, processor.encode(words), strict=True)} if words else {}
    shared = docs.sparkSession.sparkContext.broadcast((table, proto))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, proto = shared.value
        model = worker_state(("token counts", "model", hash(proto)), lambda: load(proto))
        counts = Counts(table, model, worker_state(("token counts", "cache", hash(proto)), dict))
        for column in small(batches):
            yield pa.array([counts.of(t) for t in texts_of(column)], pa.int64())

    return docs.withColumn(out, count(F.col(text)))
