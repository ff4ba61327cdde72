"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import TEXTS, clashing, frame, fuzz, long_text

from seekwell.llm.importance import Dictionary, advanced, composed, frequent_words, resample, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def plain(docs, target, n, buckets, percent, min_words, seed):
    def features(text):
        ws = plain_words(text)
        runs = [" ".join(ws[i : i + m]) for m in range(1, n + 1) for i in range(len(ws) - m + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = (Counter(b for _, text in side for b in features(text)) for side in (docs, target))
    s_all, t_all = s.total(), t.total()
    out = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in found
        )
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(plain_words(text)), len(found), weight, weight + noise, None])
    enough = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[1]))
    for rank, row in enumerate(enough[: percent * len(enough) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def corpus():
    hot = "the very common line of words that a third of all documents hold, 20 words or more in it: a b c d e f g"
    texts = [*TEXTS, *fuzz(1, 60), *[hot] * 40, long_text(3, 30_000), *(long_text(i, 40) for i in range(30)), "ÀÉ ßx ẞX K"]
    return list(enumerate(texts)) + [(None, hot), (None, None), (3, hot), (3, hot)]


@pytest.mark.parametrize(("n", "buckets", "percent", "min_words"), [(1, 10_000, 10, 20), (3, 97, 35, 2), (2, 1, 100, 0)])
def test_equals_brute_force(spark, n, buckets, percent, min_words):
    docs = corpus()
    target = [(0, "a b c d the common words"), (1, None), (2, long_text(9, 50)), (3, "")]
    got = resample(
        clashing(frame(spark, docs).repartition(7), "rank", "score", "range", "n", "word", "bucket"),
        frame(spark, target),
        n, buckets, percent, min_words, 5,
    )
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = plain(docs, target, n, buckets, percent, min_words, 5)
    rows = sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows == want
    assert any(r[5] for r in rows) and any(r[5] is None for r in rows) or percent == 100


def test_nothing(spark):
    none = frame(spark, [])
    assert resample(none, none).count() == 0
    alone = resample(frame(spark, [(1, "w " * 30)] * 10), none).collect()
    assert sorted((r.rank or 0) for r in alone) == [0] * 9 + [1]


@pytest.mark.parametrize("known", [[], [b"the"], [b"b", b"a", b"the", b"words"]])
def test_payloads_of_known_and_other_words(known):
    for text in [*map(lambda t: t or "", TEXTS), *fuzz(2, 50), "a b a b b a", "the", "x a", "a x"]:
        words = words_of(text)
        assert [w.decode() for w in words] == plain_words(text)
        crc, n_bytes = Dictionary(known).payloads(f" {b' '.join(words).decode()} ", len(words))
        assert crc.tolist() == [zlib.crc32(w) for w in words] and n_bytes.tolist() == [len(w) for w in words]


def test_composition_is_the_crc_of_the_joined_run():
    words = words_of(long_text(8, 300)) + [b"x" * 70_000, "é漢".encode()]
    crc, n_bytes = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for m, runs in composed(crc, n_bytes, 5):
        assert runs.tolist() == [zlib.crc32(b" ".join(words[i : i + m])) for i in range(len(words) - m + 1)]
    assert advanced(crc, np.zeros(len(crc), np.int64)).tolist() == crc.tolist()


def test_frequent_words_are_those_of_all_documents(spark):
    texts = [f"only{i} rare{i} often" for i in range(500)] + ["late late late"] * 30
    docs = frame(spark, list(enumerate(texts))).repartition(4, "doc_id")
    words = frequent_words(docs, known=5, summary=20)
    assert words[:2] == [b"often", b"late"]
    assert frequent_words(docs, known=1) == [b"often"] and frequent_words(frame(spark, [])) == []
