"""Token ids of whole texts, as a file of the tokenizers library gives them, each word looked up once in some MB of texts.

For tokenizers that drop white space before any merge: a text's ids are then those of its words, one after the other.
Arrow splits the texts, numbers the distinct words and puts their ids together; Python sees distinct words only, without the
capitals and the punctuation at their end where these make no difference, and encodes those that its cache does not have.
"""

from __future__ import annotations

import json
import re
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.bpe import byte_letters
from seekwell.llm.common import file_bytes, tidy, worker_state

LONGEST_KEPT = 64
CACHE_WORDS = 150_000  # of each of two generations
CACHE_ENDS = 10_000
BATCH_BYTES = 4 << 20
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # Latin ones, but for the one whose lower case ends in a mark
LETTERS_ALONE = re.compile(f"[{LETTERS}]+")
LETTERS_AND_END = f"^(?P<stem>[{LETTERS}]+)(?P<end>[{re.escape(string.punctuation)}]*)$"


def load(definition: bytes):
    """The tokenizer, if no token of it can hold or depend on ASCII white space."""
    from tokenizers import Tokenizer

    parsed = json.loads(definition)
    steps = (parsed["pre_tokenizer"] or {}).get("pretokenizers") or [parsed["pre_tokenizer"] or {}]
    drops = any(s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)
    if not drops or any(a["single_word"] for a in parsed["added_tokens"]):
        raise ValueError("this tokenizer does not encode word by word")
    tokenizer = Tokenizer.from_str(definition.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.encode("a \n b", add_special_tokens=False).ids != [
        i for w in "ab" for i in tokenizer.encode(w, add_special_tokens=False).ids
    ]:
        raise ValueError("this tokenizer does not encode word by word")
    return tokenizer


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers.

    A word of Latin letters that is new goes straight to the library's model. A cache that is full becomes the older
    generation, from which words come back when they are met again, so that frequent ones stay.
    """

    def __init__(self, definition: bytes):
        super().__init__()
        self.tokenizer = load(definition)
        self.older: dict[str, bytes] = {}
        self.letter = {b: c for c, b in byte_letters().items()}
        self.straight = all(self.direct(w) == self.encoded(w) for w in ("ab", "Ab", "ÉÇ", "straßeŷ", "Ñandú", "ªʰə"))
        self.ends: dict[str, bytes | None] = {"": b""}

    def encoded(self, word: str) -> bytes:
        return self.ids_to_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    @staticmethod
    def ids_to_bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def direct(self, letters: str) -> bytes:
        """Ids of Latin letters, which are one pre-token: straight from the library's model."""
        text = letters.lower()
        if not text.isascii():
            text = "".join(map(self.letter.__getitem__, text.encode()))
        return self.ids_to_bytes([token.id for token in self.tokenizer.model.tokenize(text)])

    def end(self, marks: str) -> bytes | None:
        """Ids of punctuation behind Latin letters; None where it is not a pre-token of its own."""
        if marks in self.ends:
            return self.ends[marks]
        ids = self.encoded(marks)
        found = ids if all(self.encoded(w + marks) == self.encoded(w) + ids for w in ("ab", "é")) else None
        if len(marks) <= LONGEST_KEPT and len(self.ends) < CACHE_ENDS:
            self.ends[marks] = found
        return found

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.direct(word) if self.straight and LETTERS_ALONE.fullmatch(word) else self.encoded(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def of_distinct(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of each of `words`, which hold no white space."""
        parts = pc.extract_regex(words, LETTERS_AND_END)  # null where a word is anything else
        ends = pc.struct_field(parts, "end").dictionary_encode()
        end = pa.array(map(self.end, ends.dictionary.to_pylist()), pa.binary()).take(ends.indices)
        stem = pc.struct_field(parts, "stem")
        stem = pc.utf8_lower(stem) if self.straight else stem
        keys = pc.if_else(end.is_valid(), stem, words).dictionary_encode()
        ids = pa.array(map(self.__getitem__, keys.dictionary.to_pylist()), pa.binary()).take(keys.indices)
        return pc.binary_join_element_wise(ids, end.fill_null(b""), b"")

    def of_texts(self, texts: pa.StringArray, end: bytes) -> pa.BinaryArray:
        """The ids of each of `texts`, none of them null, and `end`."""
        if not len(texts):
            return pa.array([], pa.binary())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.of_distinct(words.dictionary), pa.array([end], pa.binary())])
        stops = np.cumsum(split.value_lengths().to_numpy())
        # an end behind the words of each text, and the places of all ends in the row of words
        found = ids.take(pa.array(np.insert(words.indices.to_numpy(), stops, len(ids) - 1)))
        _, offsets, data = found.buffers()
        bounds = np.frombuffer(offsets, np.int32)[np.r_[0, stops + np.arange(1, len(texts) + 1)]]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), data])


def _batches(column: pa.Array) -> Iterator[pa.Array]:
    """The rows of a column of strings in slices of `BATCH_BYTES` or so."""
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(column)]):
        yield column.slice(start, stop - start)


def encode_ids(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", end_id: int | None = None) -> DataFrame:
    """`docs` with the token ids of each whole `text` in column `out`: binary, little-endian unsigned 32-bit numbers.

    Equal to the library's `encode(text, add_special_tokens=False)` without truncation and padding, then `end_id`
    if one is given. A null or empty text has no ids but that one. Other columns stay, one already named `out` is replaced.
    """
    definition = file_bytes(tokenizer)
    load(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    @tidy
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = worker_state(("library ids", hash(shared.value)), lambda: Words(shared.value))
        for column in batches:
            for part in _batches(column.cast(pa.string())):
                yield words.of_texts(part.fill_null(""), end)

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return encoded(batches)

    return docs.withColumn(out, encode.asNondeterministic()(F.col(text)))
