"""Duplicates, near duplicates, repeated strings and sketches against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import TEXTS, clashing, frame, fuzz, long_text, rows
from pyspark.sql import functions as F

from seekwell.llm.components import components
from seekwell.llm.exact_dedup import exact_copies, golomb, golomb_values
from seekwell.llm.simhash import near_components, near_fingerprints, simhash
from seekwell.llm.sketch import (
    containment,
    distinct_shingles,
    fingerprints,
    merge_sketches,
    resemblance,
    sketch,
    sketch_digits,
)
from seekwell.llm.suffix_dedup import PIECE, SuffixIndex, phrases, remove_repeats, rolling, whole_characters

BLANK = re.compile(r"[\x20\x09-\x0D]+")
ALL = TEXTS + fuzz(2, 120) + [long_text()] + TEXTS[5:9]


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def by_least(nodes, linked):
    """Least reachable node of each."""
    root = dict.fromkeys(nodes)
    for n in sorted(nodes):
        if root[n] is None:
            todo = [n]
            while todo:
                x = todo.pop()
                if root[x] is None:
                    root[x] = n
                    todo += linked[x]
    return root


# exact duplicates


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 63))
def test_golomb(values, shift):
    sorted_values = np.array(sorted({v >> shift for v in values}), np.uint64)
    assert golomb_values(golomb(sorted_values)).tolist() == sorted_values.tolist()


def exact_brute(data):
    groups, out = {}, []
    for d, t in data:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), d))
    for d, t in data:
        bare = BLANK.sub("", t or "")
        keep = min(groups[bare])[1]
        out.append((d, keep, len(groups[bare]), d == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_copies(spark, partitions):
    data = [(d * 37 % 1009, t) for d, t in rows(ALL + ["same text"] * 150 + ["same  text"] * 3 + [" "] * 40)]
    docs = clashing(frame(spark, data), "keep_id", "kept", "group_size", "part", "owner").repartition(partitions)
    got = exact_copies(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == exact_brute(data)


def test_exact_copies_edges(spark):
    assert exact_copies(frame(spark, [])).count() == 0
    got = exact_copies(frame(spark, [(None, "x"), (None, "x"), (1, "x"), (2, "y"), (2, "y")])).collect()
    unnamed = [r for r in got if r.doc_id is None]
    assert [(r.keep_id, r.group_size, r.kept) for r in unnamed] == [(None, None, True)] * 2
    assert [(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id == 2] == [(2, 2, True)] * 2
    assert [(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id == 1] == [(1, 1, True)]


# near duplicates


def bits_brute(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_texts(spark):
    got = simhash(clashing(frame(spark, rows(ALL)), "fingerprint")).collect()
    assert all(r.fingerprint % (1 << 64) == bits_brute(ALL[r.doc_id]) for r in got)


def near_bits(seed):
    """Random fingerprints, chains of one and two flipped bits, and one crowd around a centre."""
    rng = random.Random(seed)
    out = [0, 1, 3, 7, (1 << 64) - 1]
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)][:1500]
    return out


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_components_of_fingerprints(spark, max_bits):
    bits = near_bits(max_bits)
    data = [(1000 - i, b - (1 << 64) if b >> 63 else b) for i, b in enumerate(bits)]
    docs = clashing(frame(spark, data, "doc_id long, fingerprint long"), "bits", "cell", "component_id", "root", "n")
    got = {r.doc_id: r.component_id for r in near_components(docs, max_bits=max_bits).collect()}
    array = np.array(bits, np.uint64)
    close = np.bitwise_count(array[:, None] ^ array[None, :]) <= max_bits
    linked = {d: [data[j][0] for j in np.flatnonzero(close[i])] for i, (d, _) in enumerate(data)}
    assert got == by_least([d for d, _ in data], linked)


def test_near_edges(spark):
    none = frame(spark, [], "doc_id long, fingerprint long")
    assert near_components(none).count() == 0 and near_fingerprints(none).count() == 0
    data = [(5, 0), (5, 0), (None, 0), (None, 1 << 40), (7, None), (3, 1)]
    got = near_components(frame(spark, data, "doc_id long, fingerprint long")).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got if r.fingerprint is not None) == [
        (-1, 0, 3), (-1, 1 << 40, 3), (3, 1, 3), (5, 0, 3), (5, 0, 3),
    ]
    with pytest.raises(ValueError, match="2 bits"):
        near_fingerprints(none, max_bits=3)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1000, 3000)] + [(5, 5), (None, 3), (4, None)]
    edges += [(rng.randrange(200, 600), rng.randrange(200, 600)) for _ in range(250)] + [(1500, 0)]
    got = {r.node: r.root for r in components(frame(spark, edges, "a long, b long").repartition(5)).collect()}
    linked = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            linked.setdefault(a, []).append(b)
            linked.setdefault(b, []).append(a)
    assert got == by_least(list(linked), linked)
    assert components(frame(spark, [], "a long, b long")).count() == 0


# repeated strings


def repeats_brute(data, length):
    seen, out = set(), []
    for d, t in data:
        text = (t or "").encode()
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out.append((d, len(text), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize(("length", "partitions"), [(100, 1), (100, 5), (64, 3)])
def test_remove_repeats(spark, length, partitions):
    rng = random.Random(9)
    passage = long_text(1, 40)
    edges = ["".join(rng.choice("xyz ") for _ in range(30)) + passage + "".join(rng.choice("uvw ") for _ in range(30)) for _ in range(60)]
    data = rows(ALL + edges + [TEXTS[5], passage, long_text(5)[:3000]])
    shuffled = random.Random(3).sample(data, len(data))
    docs = clashing(frame(spark, shuffled), "key", "row", "part").repartition(partitions)
    got = remove_repeats(docs, length, others=("key",)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == repeats_brute(data, length)
    assert {r.key for r in got} == {"own key"}


def test_remove_repeats_edges(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    passage = long_text(2, 60)
    got = remove_repeats(frame(spark, [(None, passage), (4, passage), (4, passage)]).coalesce(1)).collect()
    assert sorted(r.n_removed for r in got) == [0, len(passage), len(passage)]
    assert next(r for r in got if r.doc_id is None).n_removed == len(passage)  # null ids come last
    with pytest.raises(ValueError, match="bytes at least"):
        remove_repeats(frame(spark, []), 40)
    with pytest.raises(ValueError, match="name of a column"):
        remove_repeats(frame(spark, [(1, "a", "b")], "doc_id long, text string, kept string"), others=("kept",))


def test_pieces_of_a_long_text(spark):
    half = long_text(8, 120_000)
    text = half + " and " + half
    assert len(text) > PIECE
    got = remove_repeats(frame(spark, [(1, text)])).first()
    assert got.n_removed >= len(half) - 1 and bytes(got.kept).decode().startswith(half)


def test_whole_characters(spark):
    data = [(1, "a漢b".encode()), (2, "漢".encode()[1:] + b"x"), (3, "é".encode()[:1]), (4, None)]
    got = frame(spark, data, "k int, b binary").select("k", whole_characters(F.col("b")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {1: "a漢b", 2: "x", 3: "", 4: ""}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=40), max_size=6), max_size=6))
def test_index_of_batches(batches):
    index, seen = SuffixIndex(8), set()
    for batch in batches:
        texts = [t.encode() for t in batch]
        if not texts:
            continue
        got = index.add(texts)
        for text, found in zip(texts, got, strict=True):
            want = []
            for s in range(len(text) - 7):
                want.append(text[s : s + 8] in seen)
                seen.add(text[s : s + 8])
            assert found.tolist() == want
    sizes = [len(level[0]) for level in index.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(sizes) + len(index.odd) == len(seen)


def test_index_hashes_few_strings_at_once(monkeypatch):
    import seekwell.llm.suffix_dedup as module

    texts = [t.encode() for t in fuzz(9, 60)]
    want = [x.tolist() for x in SuffixIndex(70).add(texts)]
    sizes = []
    monkeypatch.setattr(module, "HASHED", 50)
    monkeypatch.setattr(module, "rolling", lambda data, *a, f=module.rolling: sizes.append(len(data)) or f(data, *a))
    assert [x.tolist() for x in SuffixIndex(70).add(texts)] == want
    assert len(sizes) > 10 and max(sizes) < len(b"".join(texts)) / 2


def test_strings_of_equal_hash(monkeypatch):
    """A match of hashes alone is none."""
    import seekwell.llm.suffix_dedup as module

    monkeypatch.setattr(module, "rolling", lambda data, size, kind: np.zeros(max(0, len(data) - size + 1), kind))
    index = SuffixIndex(4)
    assert [x.tolist() for x in index.add([b"abcd", b"efgh", b"abcd", b"efgh"])] == [[False], [False], [True], [True]]
    assert [x.tolist() for x in index.add([b"efgh", b"ijkl", b"ijkl", b"abcd"])] == [[True], [False], [True], [True]]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 70))
def test_rolling(data, size):
    got = rolling(np.frombuffer(data, np.uint8), size, np.uint64)
    step = 0x9E3779B97F4A7C15
    want = []
    for i in range(len(data) - size + 1):
        h = 0
        for c in data[i : i + size]:
            h = (h * step + c) % (1 << 64)
        want.append(h)
    assert got.tolist() == want


def test_phrases_cover_every_string_once():
    texts = [t.encode() for t in fuzz(6, 40)] + [b"z" * 400]
    ends = np.cumsum([len(t) for t in texts])
    text, first, last, anchor = phrases(np.frombuffer(b"".join(texts), np.uint8), ends, 100)
    covered = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    want = [e - len(t) + s for t, e in zip(texts, ends) for s in range(len(t) - 99)]
    assert covered == want
    assert ((anchor >= last) & (anchor + 32 <= first + 100)).all()


# sketches


def shingles_of(text):
    words = words_of((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketches_are_the_least_hashes(spark):
    """Against the sets themselves: every distinct shingle is hashed on its own, and the least 128 are picked in Python."""
    texts = [*TEXTS, *fuzz(9, 20), long_text(11, 900), "a b c d e " * 60]
    sets = [shingles_of(t) for t in texts]
    every = sorted({s for found in sets for s in found})
    hashed = frame(spark, [(list(s),) for s in every], "s array<string>").select("s", F.xxhash64("s").alias("h")).collect()
    of = {tuple(r.s): r.h for r in hashed}
    got = {r.doc_id: r.s for r in frame(spark, rows(texts)).select("doc_id", sketch(F.col("text")).alias("s")).collect()}
    assert got == {i: sorted({of[s] for s in found})[:128] for i, found in enumerate(sets)}
    assert max(map(len, sets)) > 128 > len(got[0])
    digits = frame(spark, rows(texts)).select("doc_id", sketch_digits(sketch(F.col("text"))).alias("d")).collect()
    assert {r.doc_id: r.d for r in digits} == {i: "".join(f"{h % 2**64:016x}" for h in s) for i, s in got.items()}


def test_sketch_estimates(spark):
    a, b = long_text(11, 4000), long_text(12, 4000)
    texts = [None, "", "  \n", "One", "one", a, b, a + " " + b, "x y z w v u", "x y z w v"]
    df = frame(spark, rows(texts)).withColumn("s", sketch(F.col("text")))
    s = {r.doc_id: r.s for r in df.collect()}
    assert s[0] == s[1] == s[2] == [] and s[3] == s[4] and len(s[3]) == 1
    assert all(x == sorted(set(x)) and len(x) <= 128 for x in s.values())
    pair = df.select("doc_id", "s").withColumn("t", F.lit(s[7]).cast("array<long>"))
    got = {
        r.doc_id: r
        for r in pair.select(
            "doc_id",
            resemblance(F.col("s"), F.col("t")).alias("r"),
            containment(F.col("s"), F.col("t")).alias("c"),
            distinct_shingles(F.col("s")).alias("n"),
        ).collect()
    }
    whole = shingles_of(texts[7])
    for i in (5, 6, 7):
        own = shingles_of(texts[i])
        assert abs(got[i].r - len(own & whole) / len(own | whole)) < 0.15
        assert abs(got[i].c - len(own & whole) / len(own)) < 0.3
        assert abs(got[i].n / len(own) - 1) < 0.35
    assert (got[0].r, got[0].c, got[0].n) == (0.0, 1.0, 0.0)
    assert got[9].n == 1 and got[8].n == 2


def test_merge(spark):
    texts = [long_text(i, 300) for i in range(6)]
    df = frame(spark, rows(texts * 20)).select(F.lit(1).alias("k"), sketch(F.col("text")).alias("s"))
    merged = merge_sketches(df, "k", "s").first().sketch
    every = sorted({h for r in df.select("s").distinct().collect() for h in r.s})
    assert merged == every[:128]


@pytest.mark.parametrize("partitions", [1, 6])
def test_edited_texts(spark, partitions):
    data = [(d * 31 % 997, t) for d, t in rows(ALL)]
    docs = clashing(frame(spark, data), "place", "bucket", "guest", "sketch").repartition(partitions)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    order = sorted((d, t or "") for d, t in data)
    assert len(got) == len(data)
    for (d, t), (e, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (got[d].n_chars, got[d].edited_text) == (len(t), edited)
        assert len(got[d].edited_fingerprint) == min(128, len(shingles_of(edited)))
        a, b, c = shingles_of(t), shingles_of(edited), shingles_of(u)
        assert abs(got[d].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        assert abs(got[d].near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.2


def test_edited_edges(spark):
    assert fingerprints(frame(spark, [])).count() == 0
    one = fingerprints(frame(spark, [(7, "abcd")])).first()
    assert one.edited_text == "abab"
    got = fingerprints(frame(spark, [(None, "nnnn"), (5, "aaaa"), (5, "bbbb"), (None, None)])).collect()
    assert sorted(r.edited_text for r in got) == sorted(["", "nnaa", "aabb", "bb"])


def test_sketches_are_native(spark):
    plan = fingerprints(frame(spark, rows(TEXTS)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# near texts


def test_near_texts_equal_brute_force_near_the_bound(spark):
    from seekwell.llm.near_texts import near_text_components, shingles_of

    rng = random.Random(12)
    texts = [long_text(i, 200).split() for i in range(12)]
    for i in range(12):
        for edits in (2, 3, 4, 5, 6):  # resemblances on both sides of 0.8
            changed = list(texts[i])
            for at in rng.sample(range(len(changed)), edits):
                changed[at] = f"w{rng.random()}"
            texts.append(changed)
    data = rows([" ".join(t) for t in texts] + [None, "", " ", "one two", "One  two", "one three"])
    sets = [set(shingles_of((t or "").encode(), 5).tolist()) for _, t in data]
    root = list(range(len(data)))
    for a in root:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert 20 < len(set(root)) < 60
    got = {r.doc_id: r.component_id for r in near_text_components(frame(spark, data).repartition(5)).collect()}
    assert got == dict(enumerate(root))
    assert near_text_components(frame(spark, [])).count() == 0
