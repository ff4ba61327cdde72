"""The main text of web pages: boilerplate is what a host repeats, found by suffix arrays over its pages' token streams.

A page's token stream is all text outside an article: a mark for each block's element, then its words. The streams of a host are
concatenated, and their suffixes sorted by their first tokens; suffixes that agree there lie together, and where
they come from enough distinct pages, what they agree on is boilerplate. What is covered goes, and unique runs stay.

What an element says of itself comes after that: text of menus, footers, scripts and the like is none however unique, and text of an
article stays however often it is repeated, as articles quote and copy each other.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import worker_state, written
from seekwell.llm.page_blocks import ARTICLE, AROUND, MAIN, OPEN, blocks
from seekwell.operators.joins import join_facts

RUN = 8  # tokens of a repeated string
PAGES = 2  # distinct streams of a host that hold it
PART_TOKENS = 1 << 20
HOST = r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)"
PARSED = "page_id long, url string, host string, packed binary, stream binary, size long"


def token(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def parse(html: str) -> tuple[list[str], list[tuple[int, str]], np.ndarray]:
    """(blocks of the article, blocks outside it with their places, the token stream of those)."""
    found = list(blocks(html))
    inside = ARTICLE if any(b.place == ARTICLE for b in found) else MAIN
    article = [b.text for b in found if b.place == inside]
    outside = [b for b in found if b.place != inside]
    stream: list[int] = []
    for block in outside:
        stream.append(token(f"<{block.element}>"))
        stream += map(token, block.text.split())
    # what stands outside an article is never open to question
    return article, [(AROUND if article else b.place, b.text) for b in outside], np.array(stream, np.uint64)


def windows(ids: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix of `ids` by its first `run` tokens, equal where those are equal: the suffix array's order,
    by prefix doubling. Suffixes shorter than that have rank -1."""
    if len(ids) < run:
        return np.full(len(ids), -1)
    rank, length = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        ahead, rank = rank[step:], rank[: len(rank) - step]
        rank = np.unique(rank * (len(ids) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        length += step
    return np.concatenate([rank, np.full(len(ids) - len(rank), -1)])


def gram_keys(ids: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of the `run` tokens from each place on; places too near the end count tokens that are zero."""
    padded = np.concatenate([ids, np.zeros(run, np.uint64)])
    key = np.zeros(len(ids), np.uint64)
    for i in range(run):
        key = (key ^ padded[i : i + len(ids)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _grams(streams: list[np.ndarray], run: int):
    """(key, number of distinct streams that hold it) of each string of `run` tokens, from the suffix array of all streams."""
    lengths = np.array([len(s) for s in streams], np.int64)
    ids = np.concatenate(streams) if len(streams) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(streams)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))  # tokens from here to the end of the stream
    rank = windows(ids, run)
    place = np.flatnonzero((left >= run) & (rank >= 0))
    order = place[np.lexsort((owner[place], rank[place]))]  # the suffix array, copies of a string by stream
    r, o = rank[order], owner[order]
    new = np.r_[True, (r[1:] != r[:-1])] if len(r) else np.zeros(0, bool)
    other = np.r_[True, (o[1:] != o[:-1])] | new if len(r) else new
    first = np.flatnonzero(new)
    n = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return gram_keys(ids, run)[order[first]], n


def covered(stream: np.ndarray, repeated: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a string of `run` tokens whose key is among `repeated` (ascending)."""
    n = max(0, len(stream) - run + 1)
    keys = gram_keys(stream, run)[:n]
    at = np.searchsorted(repeated, keys)
    hit = (repeated[np.minimum(at, len(repeated) - 1)] == keys) if len(repeated) else np.zeros(n, bool)
    ends = np.zeros(len(stream) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + run, -1)
    return np.cumsum(ends)[: len(stream)] > 0


def unique_runs(outside: list[tuple[int, str]], is_covered: np.ndarray) -> list[str]:
    """The blocks that are open to question without the words that are covered; a block that loses all of them is gone."""
    kept, at = [], 0
    for place, text in outside:
        words = text.split(" ")
        at += 1
        if place == OPEN:
            left = [w for w, gone in zip(words, is_covered[at : at + len(words)], strict=True) if not gone]
            if left:
                kept.append(" ".join(left))
        at += len(words)
    return kept


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state(("main text",), bool)  # drops what other operators have kept
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            packed, streams = [], []
            for html in part.column("html"):
                article, outside, stream = parse(html.as_py() or "")
                # of text whose place is settled no more is needed
                left = [] if article or not any(place == OPEN for place, _ in outside) else outside
                packed.append(zlib.compress(json.dumps([article, left]).encode(), 1))
                streams.append(stream.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page_id", "url", "host")), pa.array(packed, pa.binary()), pa.array(streams, pa.binary()),
                 pa.array([len(s) // 8 for s in streams], pa.int64())],
                ["page_id", "url", "host", "packed", "stream", "size"],
            )


def _streams(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), np.uint64) for s in column]


def main_text(pages: DataFrame, run: int = RUN, min_pages: int = PAGES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars, n_outside, n_repeated) per row of `pages` (page_id, url, html).

    The text is that of the `article` elements (or what is marked as article body); of a page without, that of `main`; of a page
    without either, all blocks that stand in no surroundings, without the strings of `run` tokens or more that at least
    `min_pages` distinct streams of its host hold. Blocks are joined by an empty line. n_outside counts the tokens outside
    the article, n_repeated those of them that the host repeats.

    Equal streams count once, so copies of a page are not their own boilerplate. Strings and streams are told apart by 64-bit hashes. A null or
    empty html has an empty text; a null url, or one without a host, is of the host "". Repeated ids are pages of their own. Other columns
    are not read. A host's distinct streams are dealt to parts of about `part_tokens` tokens, each sorted on its own; parts
    exchange the hashes of their strings, and learn which the whole host repeats. One page is held in memory whole.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    parsed = given.mapInArrow(_parse, PARSED).withColumn("key", F.xxhash64("host", "stream"))
    parsed = written(parsed, "parsed")
    streams = written(parsed.where(f"size >= {run}").select("host", "key", "size", "stream").dropDuplicates(["key"]), "streams")

    # hosts with more than one part
    hosts = streams.groupBy("host").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    large = written(hosts.select("host", "n", F.ceil(F.col("size") / part_tokens).cast("int").alias("parts")).where("parts > 1"), "hosts")
    part = F.pmod(F.col("key"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = join_facts(streams, large, "host", "n", F.col("key")).withColumn("part", part)
    dealt = written(dealt.select("host", "part", "key", "stream", F.coalesce("parts", F.lit(1)).alias("parts")), "dealt")

    def grams(rows: pa.Table) -> pa.Table:
        keys, n = _grams(_streams(rows["stream"]), run)
        if rows["parts"][0].as_py() == 1:  # nothing more will be added to these
            keys, n = keys[n >= min_pages], n[n >= min_pages]
        host, part = rows["host"][0].as_py(), rows["part"][0].as_py()
        return pa.table(
            {"host": pa.array([host] * len(keys), pa.string()), "part": pa.array(np.full(len(keys), part), pa.int32()),
             "gram": pa.array(keys.view(np.int64)), "n": pa.array(n)}
        )

    found = dealt.groupBy("host", "part").applyInArrow(grams, "host string, part int, gram long, n long")
    found = written(found.withColumn("gram_key", F.xxhash64("host", "gram")), "grams")
    many = found.groupBy("gram_key").agg(F.sum("n").alias("pages"), F.count("*").alias("n")).where(f"pages >= {min_pages}")
    held = join_facts(found.drop("n"), written(many, "repeated"), "gram_key", "n", F.col("part")).where("pages is not null")

    def cover(rows: pa.Table, repeated: pa.Table) -> pa.Table:
        keys = np.unique(repeated["gram"].to_numpy().view(np.uint64)) if repeated.num_rows else np.zeros(0, np.uint64)
        marks = [covered(s, keys, run) for s in _streams(rows["stream"])]
        return pa.table(
            {"key": rows["key"], "marks": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()),
             "repeated": pa.array([int(m.sum()) for m in marks], pa.int64())}
        )

    marks = (
        dealt.groupBy("host", "part")
        .cogroup(held.select("host", "part", "gram").groupBy("host", "part"))
        .applyInArrow(cover, "key long, marks binary, repeated long")
        .where("repeated > 0")
    )
    uses = parsed.groupBy("key").agg(F.count("*").alias("n"))
    facts = written(marks.join(uses, "key"), "marks")
    joined = join_facts(parsed.drop("stream", "host"), facts, "key", "n", F.xxhash64("page_id", "url"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, texts = batch.slice(start, 256), []
                for packed, mark, size in zip(*(part.column(c) for c in ("packed", "marks", "size")), strict=True):
                    article, outside = json.loads(zlib.decompress(packed.as_buffer()))
                    if outside:
                        n = size.as_py()
                        bits = np.frombuffer(mark.as_buffer(), np.uint8) if mark.is_valid else np.zeros((n + 7) // 8, np.uint8)
                        article = unique_runs(outside, np.unpackbits(bits, count=n).astype(bool))
                    texts.append("\n\n".join(article))
                counts = pa.array([len(t) for t in texts], pa.int64())
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), counts]
                yield pa.RecordBatch.from_arrays(
                    [*columns, part.column("size"), part.column("repeated").fill_null(0)],
                    ["page_id", "url", "text", "n_chars", "n_outside", "n_repeated"],
                )

    return joined.mapInArrow(
        finish, "page_id long, url string, text string, n_chars long, n_outside long, n_repeated long"
    )
