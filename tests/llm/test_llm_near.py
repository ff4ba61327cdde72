"""Near texts against brute force: hot groups above and below the bound, and odd rows."""

import os
import random

import numpy as np
import pytest
from llm_cases import clashing, frame, long_text

import corpus_pipeline
from seekwell.llm import near_texts
from seekwell.llm.common import fresh_folder, temporary, written
from seekwell.llm.near_texts import near_text_components, shared_counts, shingles_of
from seekwell.llm.simhash import _mixed, fingerprint_of, wide_simhash
from seekwell.session import shared_dir


def plain(data):
    sets = [frozenset(shingles_of((t or "").encode(), 5).tolist()) for _, t in data]
    distinct = sorted(set(sets), key=lambda s: sets.index(s))
    root = {s: i for i, s in enumerate(distinct)}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if root[a] != root[b] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {s: new if r == old else r for s, r in root.items()}
    least = {}
    for (doc_id, _), s in zip(data, sets):
        if doc_id is not None:
            least[root[s]] = min(doc_id, least.get(root[s], doc_id))
    return sorted(((doc_id, least.get(root[s])) for (doc_id, _), s in zip(data, sets)), key=repr)


def edited(base, n, edits, rng):
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"w{rng.random()}"
        yield " ".join(words)


def odd(texts):
    """A third of the rows are one text; nulls, blanks, repeated ids, no ids, one very long text and its copy with an end."""
    data = list(enumerate(texts)) + [(10_000 + i, texts[0]) for i in range(len(texts) // 2)]
    very_long = long_text(2, 30_000)
    data += [(20_000, very_long), (20_001, very_long + " end"), (20_002, None), (20_003, ""), (20_004, " \n")]
    return data + [(3, texts[5]), (3, texts[0]), (None, texts[0]), (None, "alone without an id"), (None, None), (20_005, "one two")]


@pytest.mark.parametrize(("edits", "blocks"), [(2, 256), (7, 256), (4, 9), (7, 5)])
def test_hot_groups(spark, monkeypatch, edits, blocks):
    """Copies of one text with 1 %, 2 % (some linked) and 3.5 % (none linked) of their words replaced, in one block or in many."""
    monkeypatch.setattr(near_texts, "BLOCK_TEXTS", blocks)
    rng = random.Random(edits)
    base = long_text(1, 200).split()
    texts = [*edited(base, 70, edits, rng), *edited(base[:150], 30, edits, rng), *edited(base + base[:40], 20, 1, rng)]
    shared = long_text(4, 60)  # a passage that unlike texts share
    texts += [f"{long_text(100 + i, 30)} {shared}" for i in range(40)]
    data = odd(texts)
    docs = clashing(frame(spark, data).repartition(5), "component_id", "node", "root", "center", "low", "n", "size", "key")
    got = near_text_components(docs)
    assert got.columns == ["doc_id", "component_id"]
    want = plain(data)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 5 < len({c for _, c in want}) < len(texts)


def test_rows_of_a_hot_group_grow_with_its_texts(spark, monkeypatch):
    """Hundreds of texts that are near each other and not alike: each is compared with few centres, and blocks are copied as rows, not texts."""
    rng, n, seen, links = random.Random(3), 600, [], near_texts._links

    def counted(cells, *more):
        seen.append(cells.count())
        return links(cells, *more)

    monkeypatch.setattr(near_texts, "_links", counted)
    data = list(enumerate(edited(long_text(1, 200).split(), n, 7, rng)))
    got = near_text_components(frame(spark, data).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(data)
    assert len(seen) == 2 and seen[0] < 15 * n and seen[1] < n


def test_the_stage_links_what_simhash_or_resemblance_links(spark):
    """Texts that are mostly one passage over and over have one SimHash, and ends that make their sets of shingles unlike."""
    passage, ends = f"{long_text(7, 51)} ", [long_text(8 + i, 40) for i in range(2)]
    same = [passage * 40 + end for end in ends]  # fingerprints count repeats
    chained = f"{passage}{ends[1]}"  # resembles the second as a set, and has another fingerprint
    texts = {5: same[0], 2: "", 7: same[1], 9: chained, 1: long_text(20, 90), 11: None, 12: " \n"}
    prints = [fingerprint_of(t.encode(), 3) for t in (*same, chained)]
    assert prints[0] == prints[1] and ((prints[1] ^ prints[2]) & (2**64 - 1)).bit_count() > 2
    sets = [set(shingles_of(t.encode(), 5).tolist()) for t in (*same, chained)]
    alike = [5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    assert alike == [False, True, False]
    data = [*texts.items(), (None, same[0])]
    docs = clashing(frame(spark, data).repartition(3), "node", "fingerprint", "a", "b")
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5]
    assert kept.where("doc_id is null").count() == 1


def test_nothing(spark):
    assert near_text_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_text_components(frame(spark, [(None, None)])).collect()] == [(None, None)]


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(near_texts, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(25)]
    got = shared_counts(sets[:9], sets[9:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[9:]] for a in sets[:9]]
    assert shared_counts(sets[:1], [np.zeros(0, np.uint64)]).tolist() == [[0]]


def test_temporary_tables_are_removed(spark):
    def there():
        return set(os.listdir(shared_dir(spark).removeprefix("file:")))

    before = there()
    with temporary(spark) as keep:
        kept = keep(written(spark.range(3), "kept"))
        written(kept, "gone")
        with temporary(spark):
            written(kept, "gone too")
    assert [name.split("-")[0] for name in there() - before] == ["kept"] and kept.count() == 3
    with pytest.raises(ZeroDivisionError), temporary(spark):
        written(kept, "gone")
        1 / 0
    assert len(there() - before) == 1
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")
    near_text_components(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])).collect()
    assert {name.split("-")[0] for name in there() - before} <= {"kept", "facts", "node", "edges", "star", "least"}


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 255, 256, 700)]
    got = wide_simhash(sets, 3)
    assert got.shape == (7, 192)
    for bits, s in zip(got, sets):
        for word in range(3):
            of_each = np.unpackbits(_mixed(s, word).view(np.uint8).reshape(-1, 8), axis=1).astype(int)
            votes = 2 * of_each.sum(axis=0) - len(s)
            want = np.where(votes == 0, of_each[0], votes > 0).reshape(8, 8)
            assert bits[64 * word : 64 * (word + 1)].reshape(8, 8).tolist() == want.astype(bool).tolist()


@pytest.mark.parametrize(("size", "recall"), [(18, 0.98), (180, 0.995)])
def test_simhash_candidates_meet_at_the_bound(size, recall):
    """Pairs of sets at a resemblance of 0.8 agree in a band and are near; unlike ones hardly ever."""
    rng = np.random.default_rng(size)
    n, shared, met, unlike = 400, size * 8 // 9, 0, 0
    all_ = rng.integers(0, 1 << 63, (n, 2 * size - shared)).astype(np.uint64)
    a, b = (wide_simhash([np.unique(s) for s in part], near_texts.WORDS) for part in (all_[:, :size], all_[:, size - shared :]))
    for first, second in zip(a, b):
        near = (first[:128] != second[:128]).sum() <= near_texts.FILTER_BITS
        met += near and bool((near_texts.band_keys(first[None]) == near_texts.band_keys(second[None])).any())
    for first, second in zip(a, np.roll(b, 1, axis=0)):
        unlike += (first[:128] != second[:128]).sum() <= near_texts.FILTER_BITS
    assert met >= recall * n and unlike <= 2


@pytest.mark.parametrize(("looped", "pairs"), [(4096, 1 << 20), (4, 1 << 20), (4096, 10), (4, 10)])
def test_near_rows_are_components_within_a_key(monkeypatch, looped, pairs):
    monkeypatch.setattr(near_texts, "LOOPED", looped)
    monkeypatch.setattr(near_texts, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    middles = rng.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    prints = middles[rng.integers(0, 6, 90)]
    for _ in range(20):  # up to 20 bits of each are turned, so that some pairs of a middle are near by a chain only
        prints[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)
    key = np.sort(rng.integers(0, 8, 90))
    row, first = near_texts.near_rows(key, prints[:, 0], prints[:, 1])
    got = np.arange(90)
    got[row] = first
    want = np.arange(90)
    near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= near_texts.FILTER_BITS) & (key[:, None] == key[None])
    for _ in range(90):
        want = np.array([want[n].min() for n in near])
    assert got.tolist() == want.tolist() and 8 < len(set(want)) < 80
