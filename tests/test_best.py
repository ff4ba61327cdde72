import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seekwell.operators.best import BestRows, merge_best

SCHEMA = "query long, id long, score double, cost long"


def whole(rows, budget):
    """The rule itself: in order of score, while the costs fit."""
    out = {}
    for q in {r[0] for r in rows}:
        used = 0
        for _, i, s, c in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            used += c
            if used > budget:
                break
            out[(q, i)] = used
    return out


def rows_of(draw_rows):
    return [(q, i, s / 4.0, c) for i, (q, s, c) in enumerate(draw_rows)]


RAW = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(1, 4)), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(RAW, st.integers(1, 12), st.integers(1, 40), st.integers(0, 30), st.sampled_from([0.25, 4e-7]))
def test_cutting_parts_first_changes_nothing(raw, budget, step, max_pending, unit):
    """With the small unit, scores that differ are ties after rounding."""
    rows = [(q, i, s * unit, c) for i, (q, s, c) in enumerate(raw)]
    best = BestRows(3, budget, ["id"], max_pending)
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        scores = np.full((3, len(part)), -np.inf)
        for n, (q, _, s, _) in enumerate(part):
            scores[q, n] = s
        table = pa.table({"id": [r[1] for r in part], "cost": [r[3] for r in part]})
        best.offer(table, scores)
    kept = best.result().to_pylist()
    again = [(r["query"], r["id"], r["score"], r["cost"]) for r in kept]
    rounded = [(q, i, float(np.round(s, 6)), c) for q, i, s, c in rows]
    assert whole(again, budget) == whole(rounded, budget)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(1, 3), st.integers(1, 40))
def test_plain_top_k_of_one_query(raw, k, step):
    best = BestRows(1, k, ["id"], 0)
    for start in range(0, len(raw), step):
        part = raw[start : start + step]
        table = pa.table({"id": list(range(start, start + len(part))), "cost": [1] * len(part)})
        best.offer(table, np.array([part]) * 4e-7)
    got = [(r["score"], r["id"]) for r in best.result().to_pylist()]
    want = sorted((-float(np.round(s * 4e-7, 6)), i) for i, s in enumerate(raw))[:k]
    assert got == [(-s, i) for s, i in want]


def test_a_cheap_row_does_not_slip_past_one_that_does_not_fit(spark):
    # 60 fits in 100, the next 60 does not, so packing stops: the 30 must not come in
    rows = [(0, 0, 3.0, 60), (0, 1, 2.0, 60), (0, 2, 1.0, 30), (1, 5, 1.0, 100), (1, 6, 0.5, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 2, 5):
        got = merge_best(df.repartition(n), ["query"], ["id"], 100).collect()
        assert {(r["query"], r["id"]) for r in got} == {(0, 0), (1, 5)}


@settings(max_examples=5, deadline=None)
@given(RAW, st.integers(1, 12))
def test_merge_equals_the_rule_for_any_partitioning(spark, raw, budget):
    rows = rows_of(raw)
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 7):
        got = merge_best(df.repartition(n), ["query"], ["id"], budget).collect()
        assert {(r["query"], r["id"]): r["used"] for r in got} == whole(rows, budget)
        for q in {r["query"] for r in got}:
            assert sorted(r["rank"] for r in got if r["query"] == q) == list(
                range(1, 1 + sum(r["query"] == q for r in got))
            )
