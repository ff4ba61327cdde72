"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every token encodes to itself and every two
neighbours encode to themselves as a pair. So each prefix of a pre-token has one possible last token: the token
that ends there, whose own start is a prefix that is solved, and which is compatible with that prefix's last token. An
automaton over the vocabulary gives all tokens that end at each byte; back-pointers give the ids.

Pre-tokens repeat, and so do the stretches between spaces. Each worker keeps the ids of those that it has met lately.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import file_bytes, small, worker_state

# Fixed value: the published pattern that cuts text into pre-tokens before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST_KEPT = 64
CACHE_UNITS = 130_000  # of a generation, of which there are two
CACHE_WORDS = 250_000
CACHE_PAIRS = 200_000
SEEN = (1 << 21) - 1
NONE = 1 << 60
SIGNS = frozenset(".,;:!?")  # signs that are a pre-token of their own behind letters
SPACE_RUN = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """The bytes of each id, as a tokenizer file says; all that decoding needs."""

    def __init__(self, definition: bytes):
        parsed = json.loads(definition)
        model, split = parsed["model"], parsed["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a byte-level BPE tokenizer without prefix space")
        if parsed["normalizer"] or model.get("ignore_merges") or any(
            a["lstrip"] or a["rstrip"] or a["single_word"] for a in parsed["added_tokens"]
        ):
            raise ValueError("normalizers, ignored merges and stripping added tokens are not supported")
        letters = byte_letters()
        raw = {i: bytes(map(letters.__getitem__, t)) for t, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in parsed["added_tokens"]}
        bytes_of = raw | {i: t.encode() for t, i in self.added.items()}
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]

    def decode(self, ids: pa.Array) -> str:
        if ids.null_count:
            ids = ids.drop_null()
        numbers = ids.to_numpy(zero_copy_only=False)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(self.table)):
            numbers = numbers[(numbers >= 0) & (numbers < len(self.table))]
        return b"".join(map(self.table.__getitem__, numbers.tolist())).decode("utf-8", "replace")


class Vocabulary(TokenBytes):
    """The merges as well, and the automaton of all tokens."""

    def __init__(self, definition: bytes):
        import ahocorasick
        import regex

        super().__init__(definition)
        model, raw = json.loads(definition)["model"], {i: b for i, b in enumerate(self.table) if b}
        for token in self.added.values():
            raw.pop(token, None)
        self.rank: dict[tuple[int, int], int] = {}
        # per token: the merge that makes it (NONE for single bytes) and its halves
        self.made: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[x, y] = n
            if z not in self.made:
                self.made[z], self.left[z], self.right[z] = n, x, y
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for i, b in raw.items():
            if self.whole(i, len(b)):
                self.matches.add_word(b.decode("latin-1"), (i, len(b)))
        self.matches.make_automaton()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words = regex.compile(PATTERN).findall
        self.units = regex.compile(r"(?<=[^\s\x1c-\x1f])(?= )")

    def whole(self, token: int, n_bytes: int) -> bool:
        """Whether a token encodes to itself: single bytes do, and a merged one if its halves stay apart until its merge."""
        made = self.made.get(token)
        return n_bytes == 1 if made is None else self.apart(self.left[token], self.right[token], made)

    def apart(self, a: int, b: int, until: int = NONE) -> bool:
        """Whether the border between neighbours `a` and `b` survives all merges before merge `until`.

        The tokens that touch the border change as merges are done. Going back in time from the finished tokens, the
        younger of the two is split, and each two that touched are checked: their own merge, if there is
        one, must come later than the merge that took one of them away. Of equal merges the leftmost goes first.
        """
        # the border holds while the time of (a, b)'s own merge is not before `end`
        end = until
        while True:
            own = self.rank.get((a, b))
            if own is not None and own < end:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                end, a = made_a, self.right[a]  # left of the border: at equal merges it goes before (a, b)
            else:
                end, b = made_b + 1, self.left[b]  # right of the border: (a, b) would go before it

    def compatible(self, a: int, b: int) -> bool:
        key = a + 1 << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.older_pairs.get(key)
            if known is None:
                known = self.apart(a, b)
            if len(self.pairs) >= CACHE_PAIRS:
                self.older_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = known
        return known

    def solve(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word if word.isascii() else word.encode().decode("latin-1")
        n = len(data)
        # per prefix its last token, moved to the high half of a pair's key; 0 where there is none yet
        last, back = [0] * (n + 1), [0] * (n + 1)
        known, compatible = self.pairs.get, self.compatible
        for end, (token, size) in self.matches.iter(data):
            end += 1
            if last[end]:
                continue
            start = end - size
            if start:
                before = last[start]
                if not before:
                    continue
                fits = known(before | token)
                if fits is None:
                    fits = compatible((before >> 32) - 1, token)
                if not fits:
                    continue
            last[end], back[end] = token + 1 << 32, start
        ids = []
        while n:
            ids.append((last[n] >> 32) - 1)
            n = back[n]
        return ids[::-1]

class Recent(dict):
    """Text -> its ids as bytes, as `solve` finds them, for texts met lately.

    There are two generations: when the younger one is full it becomes the older, and what is met there again moves
    to the younger. With `twice` a text is kept from the second time on, so that those that are met once take no room.
    """

    def __init__(self, solve: Callable[[str], bytes], room: int, twice: bool):
        super().__init__()
        self.solve, self.room, self.twice = solve, room, twice
        self.older: dict[str, bytes] = {}
        self.seen = bytearray(SEEN + 1 if twice else 0)

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.solve(text)
            if len(text) > LONGEST_KEPT:
                return ids
            if self.twice and not self.seen[slot := hash(text) & SEEN]:
                self.seen[slot] = 1
                return ids
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
            self.seen = bytearray(len(self.seen))
        self[text] = ids
        return ids


class Units:
    """Encodes texts by units, each a stretch between two spaces. Ids are 32-bit numbers in the machine's order."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = Recent(lambda word: array("i", vocabulary.solve(word)).tobytes(), CACHE_WORDS, twice=False)
        self.units = Recent(self.solve_unit, CACHE_UNITS, twice=True)
        self.added = tuple(vocabulary.added)

    def solve_unit(self, unit: str) -> bytes:
        """Ids of a unit and the space before it. Letters are one pre-token, and a sign behind them is another."""
        if unit.isalpha():
            return self.words[" " + unit]
        if unit[-1:] in SIGNS and unit[:-1].isalpha():
            return self.words[f" {unit[:-1]}"] + self.words[unit[-1]]
        return self.solve_stretch(" " + unit)

    def solve_stretch(self, stretch: str) -> bytes:
        """Ids of a stretch of text that no pre-token crosses, added tokens included."""
        ids: list[bytes] = []
        plain = not any(map(stretch.__contains__, self.added))
        for i, part in enumerate((stretch,) if plain else self.vocabulary.cut.split(stretch)):
            if i % 2:
                ids.append(array("i", [self.vocabulary.added[part]]).tobytes())
            elif part:
                ids += map(self.words.__getitem__, self.vocabulary.words(part))
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """A pre-token never runs on from a character to a space, so a text is cut there. White space before a
        space keeps a stretch together."""
        if SPACE_RUN.search(text):
            first, *rest = self.vocabulary.units.split(text)
            rest = [unit[1:] for unit in rest]
        else:
            first, *rest = text.split(" ")
        return self.solve_stretch(first) + b"".join(map(self.units.__getitem__, rest))


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the token ids of each whole `text` in column `out` (array of int).

    `tokenizer` is a byte-level BPE file of the tokenizers library; the ids are those of its
    `encode(text, add_special_tokens=False)`. Strings of added tokens inside a text become those tokens, as is that library's
    default. A null or empty text has no ids; there is no truncation. Other columns stay, one already named `out` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        units = worker_state(("bpe", "units", hash(shared.value)), lambda: Units(Vocabulary(shared.value)))
        for column in small(batches):
            ids, ends = array("i"), [0]
            for text in column:
                ids.frombytes(units.encode(text.as_py() or ""))
                ends.append(len(ids))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            del ids

    # not to be run once more for every column that is made from the ids
    return docs.withColumn(out, encode.asNondeterministic()(F.col(text)))


def bpe_decode(docs: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text of the token ids in column `out`, added tokens included.

    Bytes that are not UTF-8, as at a torn character, become U+FFFD. Ids without a token give nothing; null ids an empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = worker_state(("bpe", "bytes", hash(shared.value)), lambda: TokenBytes(shared.value))
        for column in small(batches):
            yield pa.array([known.decode(row.values) if row.is_valid else "" for row in column], pa.string())

    return docs.withColumn(out, decode.asNondeterministic()(F.col(ids)))
