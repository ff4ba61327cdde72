"""Near duplicates by resemblance: texts that share at least 0.8 of their word shingles, and the components they form.

Candidates are found by SimHash: fingerprints of 1,152 bits over the sets of shingles, cut in 82 bands of 14. Texts that agree in a whole band
meet there, and those whose first 128 bits differ in at most 40 are near; a pair that differs in a share p of its bits meets with chance
1 - (1 - (1 - p)^14)^82: 0.9998 at a resemblance of 0.8, where p is acos(8/9) / pi = 0.15. What is near in a band, chains included, has the
least text among it as its centre. A large group has other centres in each band and key, so a centre that meets a smaller one hands its texts
over to that. Each text is compared with its centres first, which joins what is alike. Where not all of a centre's texts are linked with one centre, they are cut in blocks, by size
first, as texts whose sizes differ by more than a quarter cannot be alike, and pairs of blocks are compared inside tasks. Neither pairs nor the copies
of texts for them are rows: a block of texts is one row. A task counts the shingles that its texts share, on the whole sets, and emits links, at most one per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.llm.common import temporary, tidy, worker_state, written
from seekwell.llm.components import components, forest
from seekwell.llm.simhash import wide_simhash
from seekwell.operators.joins import join_facts

SEED = 42
WORDS = 18  # of 64 bits of a fingerprint
BAND = 14  # bits
BANDS = 64 * WORDS // BAND
FILTER_BITS = 40  # of the first 128, that near texts may differ in; a pair at 0.8 differs in 19 with a deviation of 4
CHUNK = 1 << 18  # shingles that are counted together
LOOPED = 4096  # rows of a band's key up to which all its pairs are taken gap by gap
PAIRS = 1 << 20
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 19
COLUMNS = 4096  # shingles whose holders are counted together
CLASS = 1.26  # texts whose sizes differ by a factor of 1.25 at most are in one size class or in neighbouring ones
BROADCAST_NODES = 1 << 20
CELL = "center long, low long, high long"
MEMBERS = "node long, size long, center long, center_size long"


def shingles_of(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    import xxhash

    parts = text.lower().split()  # of bytes: ASCII letters and white space only
    if len(parts) <= words:
        shingles = iter([b" ".join(parts)])
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def band_keys(bits: np.ndarray) -> np.ndarray:
    """A row of `BANDS` keys per fingerprint, the band in the high bits; two share a key where they agree in the whole band."""
    cut = bits[:, : BANDS * BAND].reshape(len(bits), BANDS, BAND).astype(np.float32)
    return (cut @ (2.0 ** np.arange(BAND, dtype=np.float32))).astype(np.int32) + (np.arange(BANDS, dtype=np.int32) << BAND)


def _prints(words: int):
    """Texts (node, text) to (node, size, print), the SimHash of the text's set of shingles as bytes."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("near texts",), bool)  # drops what other operators have kept

        def printed(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            packed = np.packbits(wide_simhash(sets, WORDS), axis=1)
            columns = [pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p.tobytes() for p in packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["node", "size", "print"])

        nodes, sets, size = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                nodes.append(node.as_py())
                sets.append(shingles_of(text.as_py(), words))
                size += len(sets[-1])
                if size >= CHUNK:
                    yield printed(nodes, sets)
                    nodes, sets, size = [], [], 0
        if sets:
            yield printed(nodes, sets)

    return prints


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints (node, size, print) to (key, node, size, a, b), a row per band; a and b are the first 128 bits."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            keys = band_keys(np.unpackbits(packed, axis=1)).ravel()
            first = np.ascontiguousarray(packed[:, :16]).view(np.int64)
            same = [part.column(0).to_numpy(), part.column(1).to_numpy(), first[:, 0], first[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(c, BANDS)) for c in same)], ["key", "node", "size", "a", "b"])


def _near(a: np.ndarray, b: np.ndarray, at: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[at] ^ a[others]) + np.bitwise_count(b[at] ^ b[others]) <= FILTER_BITS


def _reached(a: np.ndarray, b: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a large group: from one row after another to those that it is near, which are not looked for again."""
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = _near(a, b, np.array([at]), rest)
            found, rest = rest[close], rest[~close]
            if len(found):
                yield np.full(len(found), at), found
                queue.extend(found)


def near_rows(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first): the rows, sorted by key, that are near others of their key, directly or by chains, but for the first of each chain."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(starts, size))  # rows of the key from here on
    found, pairs = [], 0

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal found, pairs
        found.append((x, y))
        pairs += len(x)
        if pairs > PAIRS:
            found = [forest(*(np.concatenate(side) for side in zip(*found)))]
            pairs = 0

    at, gap = np.flatnonzero(np.repeat(size <= LOOPED, size)), 1
    while len(at := at[left[at] > gap]):
        close = at[_near(a, b, at, at + gap)]
        add(close, close + gap)
        gap += 1
    for start, n in zip(starts[size > LOOPED], size[size > LOOPED]):
        for x, y in _reached(a, b, np.arange(start, start + n)):
            add(x, y)
    x, y = (np.concatenate(side) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return forest(x, y) if len(x) else (x, y)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_bands`, sorted by key and node, to MEMBERS: the texts that are near others, with the least of these, and that one itself."""

    def met(key: np.ndarray, node: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        row, first = near_rows(key, a.view(np.uint64), b.view(np.uint64))
        own = np.unique(first)
        row, first = np.r_[row, own], np.r_[first, own]
        pairs = np.unique(np.stack([node[row], size[row], node[first], size[first]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T], ["node", "size", "center", "center_size"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (held and held[-1][0][-1] != now[0][0]):
            yield met(*(np.concatenate(c) for c in zip(*held, [c[:cut] for c in now])))
            held = []
        held.append([c[cut:] for c in now])  # the last key may go on
    if held:
        yield met(*(np.concatenate(c) for c in zip(*held)))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `a` has in common with each of `b`."""
    sets = [*a, *b]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    several = counts[element] > 1
    owner, element = owner[several], element[several]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    numbers = np.cumsum(np.r_[0, element[1:] != element[:-1]]) if len(element) else element
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(numbers[-1]) + 1 if len(numbers) else 0, COLUMNS):
        low, high = np.searchsorted(numbers, [start, start + COLUMNS])
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[owner[low:high], numbers[low:high] - start] = 1
        out += holds[: len(a)] @ holds[len(a) :].T
    return out  # whole numbers below 2 ** 24 are exact


def _compare(rows: pa.Table) -> pa.Table:
    """Links (a, b) of one cell: its texts of the low block with those of the high block, or of its one block with each other."""
    in_low = rows["in_low"].to_numpy(zero_copy_only=False)
    one_block = rows["low"][0].as_py() == rows["high"][0].as_py()
    if "texts" in rows.column_names:  # a row per block
        lists = rows["texts"].combine_chunks()
        in_low = np.repeat(in_low, lists.value_lengths().to_numpy())
        rows = pa.Table.from_struct_array(lists.flatten())
    node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if (root == root[0]).all():
        return none
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["shingles"]]
    left = np.flatnonzero(in_low)
    right = left if one_block else np.flatnonzero(~in_low)
    if not len(left) or not len(right):
        return none
    size = np.array([len(s) for s in sets])
    shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
    alike = 5 * shared >= 4 * (size[left][:, None] + size[right][None, :] - shared)
    alike &= root[left][:, None] != root[right][None, :]
    x, y = np.nonzero(alike)
    if not len(x):
        return none
    a, b = forest(node[left][x], node[right][y])
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the whole set of each of `nodes`, a written table of distinct ones."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingles_of(t.as_py(), words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    # texts are not shuffled to find a few of them, as long as the ids of those are few megabytes
    few = nodes.count() <= BROADCAST_NODES
    asked = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    return written(asked.dropDuplicates(["node"]).mapInArrow(tidy(shingled), "node long, shingles binary"), "shingles")


def _links(cells: DataFrame) -> DataFrame:
    """The links of all cells (CELL, in_low, and node, root and shingles or `texts`, a list of these)."""
    return written(cells.groupBy("center", "low", "high").applyInArrow(_compare, "a long, b long"), "links")


def _handed_over(members: DataFrame) -> DataFrame:
    """MEMBERS in fewer groups: a centre that is a text of other centres leaves its texts to the least of those. What had a centre in common
    still has. One step only: chains of groups are not followed, as chance would join all texts of a large table by them."""
    least = members.groupBy("node").agg(F.min(F.struct("center", "center_size")).alias("to"))
    counts = members.groupBy("center").agg(F.count("*").alias("n"))
    heads = written(counts.join(least.withColumnRenamed("node", "center"), "center").select("center", "n", "to.*").toDF("center", "n", "to", "to_size"), "heads")
    moved = join_facts(members.select("node", "size", "center"), heads, "center", "n", F.col("node"))
    moved = moved.select("node", "size", F.col("to").alias("center"), F.col("to_size").alias("center_size"))
    return written(moved.distinct(), "members")


def _star_cells(members: DataFrame) -> DataFrame:
    """Each centre with each of its texts that may be alike: cells of `BLOCK_TEXTS` texts or so, and the centre in each of them."""
    near = F.least("size", "center_size") * 5 >= F.greatest("size", "center_size") * 4
    others = members.where(near & (F.col("node") != F.col("center")))
    sized = others.groupBy("center").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    sized = written(sized.select("center", "n", _blocks("n", "total").alias("blocks")), "stars")
    dealt = join_facts(others, sized, "center", "n", F.col("node"))
    dealt = dealt.select(
        "center", F.lit(-1).cast("long").alias("low"), F.pmod(F.xxhash64("node"), "blocks").cast("long").alias("high"),
        F.lit(False).alias("in_low"), "node", "node",
    ).toDF("center", "low", "high", "in_low", "node", "root")
    centers = sized.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("high"))
    centers = centers.select("center", F.lit(-1).cast("long"), "high", F.lit(True), "center", "center")
    return dealt.unionAll(centers)


def _blocks(n: str, total: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("long")


def _block_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of blocks of each centre's texts (center, node, size, root), where the blocks' sizes allow a link. A block is a row, with
    its `texts`, so rows are as many as pairs of blocks."""
    classed = members.withColumn("class", F.floor(F.log("size") / F.log(F.lit(CLASS))).cast("long"))
    classes = classed.groupBy("center", "class").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    classes = classes.select("center", "class", "n", _blocks("n", "total").alias("blocks"))
    ascending = Window.partitionBy("center").orderBy("class")  # a row per size class, of which there are some dozens
    beside = lambda step: F.when(
        F.lead("class", step).over(ascending) == F.col("class") + step, F.lead("blocks", step).over(ascending)
    )
    classes = classes.withColumns({"above": beside(1), "below": beside(-1)}).withColumn("key", F.xxhash64("center", "class"))
    classes = written(classes.drop("center", "class"), "classes")
    dealt = join_facts(classed.withColumn("key", F.xxhash64("center", "class")), classes, "key", "n", F.col("node"))
    block = F.pmod(F.xxhash64("node"), "blocks")
    place = lambda size_class, number: size_class * F.lit(1 << 32) + number
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    own = place(F.col("class"), block)
    partners = F.concat(
        F.transform(upto(F.col("blocks")), lambda i: place(F.col("class"), i)),
        F.transform(upto(F.col("above")), lambda i: place(F.col("class") + 1, i)),
        F.transform(upto(F.col("below")), lambda i: place(F.col("class") - 1, i)),
    )
    whole = dealt.withColumn("own", own).join(sets, "node")
    packed = whole.groupBy("center", "own", "class", "blocks", "above", "below").agg(
        F.collect_list(F.struct("node", "root", "shingles")).alias("texts")
    )
    copied = packed.withColumn("other", F.explode(partners))
    return copied.select(
        "center", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") <= F.col("other")).alias("in_low"), "texts",
    )


def text_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, text): the texts as bytes, null as empty, and the hashes that tell them apart."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.xxhash64(whole).alias("node"), whole.alias("text"))


def near_text_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, links: DataFrame | None = None
) -> DataFrame:
    """(`doc_id`, `component_id`) per row: the least `doc_id` reached over links of resemblance 0.8 or more.

    `links` (a, b) are further links, found by other means, between nodes of `text_nodes`; they count as those of resemblance do.

    Resemblance is that of the sets of shingles of `words` words: A-Z lower-cased, between ASCII white space; a text of fewer
    words is one shingle, and null, empty and blank texts are alike. Texts and shingles are told apart by 64-bit hashes. Chains count.

    Rows that repeat an id are rows of their own, with the components of their texts. A row without an id joins texts as any other, but
    names no component: one of such rows alone has a null one. No rows give none. Other columns are not read.
    A text is shuffled only if its fingerprint is near another. Texts that are near by it and stay unlike are compared with each other block by block
    within their size class: work that is quadratic in such a group, spread over tasks, and no rows. The tables made on the way are removed.
    """
    texts = text_nodes(docs, text)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias(doc_id), F.xxhash64(whole).alias("node"))
    with temporary(docs.sparkSession) as keep:
        printed = texts.mapInArrow(tidy(_prints(words)), "node long, size long, print binary")
        prints = written(printed.dropDuplicates(["node"]), "prints")
        bands = prints.mapInArrow(tidy(_bands), "key int, node long, size long, a long, b long")
        together = bands.repartition("key").sortWithinPartitions("key", "node")  # most rows meet nothing near
        members = _handed_over(written(together.mapInArrow(tidy(_members), MEMBERS).distinct(), "met"))
        sets = _sets(written(members.select("node").distinct(), "nodes"), texts, words)
        stars = _links(_star_cells(members).join(sets, "node"))

        # texts that are linked with one centre have one root; that is all that is known of components until the end
        roots = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = written(rooted.select("center", "node", "size", "root"), "rooted")
        mixed = rooted.groupBy("center").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("center")
        rest = written(rooted.join(mixed, "center", "left_semi"), "mixed")
        more = _links(_block_cells(rest, sets))

        found = stars.unionAll(more)
        roots = components(found if links is None else found.unionAll(links.select("a", "b")))
        points = rows.groupBy("node").agg(F.min(doc_id).alias("least"), F.count("*").alias("n"))
        points = written(points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "points")
        lowest = points.groupBy("root").agg(F.min("least").alias("component_id"))
        facts = keep(written(points.join(lowest, "root").select("node", "n", "component_id"), "facts"))
    return join_facts(rows, facts, "node", "n", F.col(doc_id)).select(doc_id, "component_id")
