import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekwell.functions import sign_planes, term_counts, windows, words
from seekwell.operators import chunk_documents

TEXTS = [
    None,
    "",
    "  ",
    "!!! ... ---",
    "one",
    "One, ONE one; two",
    "Élan élan ÉLAN naïve",
    "a\tb\nc  d",
    "x1 2y 3.14",
]


def py_words(text):
    return [w for w in re.sub(r"[\W_]+", " ", text or "").lower().split(" ") if w]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words(spark):
    got = frame(spark, TEXTS).select(words(F.col("text")).alias("w")).collect()
    assert [r["w"] for r in got] == [py_words(t) for t in TEXTS]
    assert [] in [r["w"] for r in got] and ["one"] in [r["w"] for r in got]


def test_term_counts(spark):
    got = frame(spark, TEXTS).select(term_counts(words(F.col("text"))).alias("c")).collect()
    for row, text in zip(got, TEXTS, strict=True):
        ws = py_words(text)
        assert {c["term"]: c["tf"] for c in row["c"]} == dict(Counter(ws))
        assert all(c["doc_len"] == len(ws) for c in row["c"])


def py_windows(text, width, stride):
    ws, out, start = text.split(), [], 0
    while ws:
        out.append(ws[start : start + width])
        if start + width >= len(ws):
            break
        start += stride
    return [" ".join(w) for w in out]


def test_windows_match_a_loop_at_every_length(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(40)]
    for width, stride in ((1, 1), (5, 5), (7, 3), (30, 29)):
        got = chunk_documents(frame(spark, texts), width, stride).collect()
        for doc_id, text in enumerate(texts):
            mine = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["chunk"])
            assert [r["text"] for r in mine] == py_windows(text, width, stride)
            assert [r["chunk"] for r in mine] == list(range(len(mine)))
            assert [r["n_words"] for r in mine] == [len(r["text"].split()) for r in mine]


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.text(alphabet="ab \n\t", max_size=30), min_size=1, max_size=8),
    st.integers(1, 6),
    st.data(),
)
def test_windows_lose_no_word(spark, texts, width, data):
    stride = data.draw(st.integers(1, width))
    got = chunk_documents(frame(spark, texts), width, stride).collect()
    for doc_id, text in enumerate(texts):
        mine = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["chunk"])
        seen = {}
        for r in mine:
            for i, w in enumerate(r["text"].split(" ")):
                seen[r["chunk"] * stride + i] = w
        assert [seen[i] for i in sorted(seen)] == text.split()


def test_windows_refuse_gaps():
    for width, stride in ((3, 4), (3, 0)):
        try:
            windows(F.lit("x"), width, stride)
        except ValueError:
            continue
        raise AssertionError("a stride beyond the width loses words")


def test_planes_are_fixed_and_mixed():
    a = sign_planes(40, 64)
    assert (a == sign_planes(40, 64)).all() and set(a.ravel()) == {-1.0, 1.0}
    assert 0.4 < (a > 0).mean() < 0.6
