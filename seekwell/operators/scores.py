"""Scoring of a batch of items against a block of queries, inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seekwell.operators.best import APART, SCORE_DIGITS, BestRows

BM25 = "bm25"
TFIDF = "tfidf"
SLICE_CELLS = 1 << 21


@dataclass(frozen=True)
class QueryBlock:
    """Queries as a sparse term matrix, term by term: (query, weight) of each."""

    ids: np.ndarray
    vocab: list[str]
    first: np.ndarray  # entries of term t are first[t] .. first[t + 1]
    query: np.ndarray
    count: np.ndarray
    weight: dict[str, np.ndarray]  # by method; idf and query count are in it
    mean_len: float
    k1: float
    b: float

    @classmethod
    def of(cls, block: pa.Table) -> QueryBlock:
        """The terms of a block with columns query and ws; weights come by `weighed`."""
        n = max(block.num_rows, 1)
        lists = block["ws"].combine_chunks()
        query = np.repeat(np.arange(block.num_rows), _lengths(lists))
        encoded = pc.dictionary_encode(lists.flatten())
        term = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes, count = np.unique(term * n + query, return_counts=True)
        vocab = encoded.dictionary.to_pylist()
        first = np.searchsorted(codes // n, np.arange(len(vocab) + 1))
        return cls(block["query"].to_numpy(), vocab, first, codes % n, count, {}, 0.0, 0.0, 0.0)

    def weighed(self, stats: dict[str, tuple[int, int]], k1: float, b: float) -> QueryBlock:
        """With the weights that (df, total_len) by term give; the empty term counts all items."""
        n_items, total_len = stats.get("", (0, 0))
        df = np.array([stats.get(t, (0, 0))[0] for t in self.vocab], dtype=float)
        idf = {
            BM25: np.log(1.0 + (n_items - df + 0.5) / (df + 0.5)),
            TFIDF: np.log(1.0 + n_items / np.maximum(df, 1.0)),
        }
        fan = np.diff(self.first)
        weight = {method: self.count * np.repeat(v, fan) for method, v in idf.items()}
        mean_len = total_len / n_items if n_items else 0.0
        return QueryBlock(self.ids, self.vocab, self.first, self.query, self.count, weight, mean_len, k1, b)

    def slice_rows(self, n_methods: int) -> int:
        """How many items to score at once, so that the cells of a slice stay few."""
        return max(1, SLICE_CELLS // max(1, n_methods * len(self.ids), len(self.query) // 8))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _term_weight(method: str, tf: np.ndarray, length: np.ndarray, q: QueryBlock) -> np.ndarray:
    if method == BM25:
        return tf * (q.k1 + 1.0) / (tf + q.k1 * (1.0 - q.b + q.b * length / q.mean_len))
    return (1.0 + np.log(tf)) / np.sqrt(length)


def _scores(
    n: int, item: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, q: QueryBlock, methods
) -> np.ndarray:
    """(methods x queries) x items, -inf where no term is shared, from (item, term) entries."""
    fan = q.first[term + 1] - q.first[term]
    entry = np.repeat(q.first[term] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
    cell = q.query[entry] * n + np.repeat(item, fan)
    out = []
    for method in methods:
        w = np.repeat(_term_weight(method, tf.astype(float), length, q), fan)
        s = np.bincount(cell, weights=w * q.weight[method][entry], minlength=len(q.ids) * n)
        out.append(np.where(s > 0, s, -np.inf).reshape(len(q.ids), n))
    return np.concatenate(out)


def _named(found: pa.Table | None, q: QueryBlock, methods: list[str]) -> Iterator[pa.RecordBatch]:
    if found is not None:
        code = found["query"].to_numpy()
        found = found.drop_columns(["query"])
        found = found.append_column("query", pa.array(q.ids[code % len(q.ids)]))
        found = found.append_column("method", pa.array(methods).take(pa.array(code // len(q.ids))))
        yield from found.combine_chunks().to_batches()


def _scored_slices(
    batches: Iterable[pa.RecordBatch], q: QueryBlock, methods: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Items with a `norm` column, some at a time, without it, and their scores."""
    step = q.slice_rows(len(methods))
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        vocab = pa.array(q.vocab, rows["norm"].type)
        for start in range(0, rows.num_rows, step):
            part = rows.slice(start, step)
            texts = part["norm"].combine_chunks()
            lists = pc.split_pattern(texts, " ")
            pieces = _lengths(lists)
            # the split of an empty text has one piece, and no word
            length = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pieces).astype(float)
            found = pc.index_in(lists.flatten(), value_set=vocab)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            item = np.repeat(np.arange(len(texts)), pieces)[known]
            code, tf = np.unique(
                item * len(vocab) + found.drop_null().to_numpy().astype(np.int64), return_counts=True
            )
            item, term = np.divmod(code, len(vocab))
            yield part.drop_columns(["norm"]), _scores(len(texts), item, term, tf, length[item], q, methods)


def scan_texts(shared, methods: list[str], ids: list[str], budget: int, other: bool = False):
    """The task over items with a `norm` column: score batch by batch, send the best at the end.

    With `other`, of two methods, each row has its score by the other one too.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = QueryBlock(**shared.value)
        best = BestRows(len(methods) * len(q.ids), budget, ids)
        for rows, scores in _scored_slices(batches, q, methods):
            best.offer(rows, scores, np.roll(scores, len(q.ids), axis=0) if other else None)
        yield from _named(best.result(), q, methods)

    return run


def scan_better(shared, marks, methods: list[str]):
    """The task that counts, for marked rows, the items ahead of them: (slot, better).

    `marks` broadcasts arrays code, score, doc_id, sorted by code: rows of list `code` (method and query), whose
    place in the arrays is their slot.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = QueryBlock(**shared.value)
        code, score, doc_id = marks.value
        codes, first = np.unique(code, return_index=True)
        ends = np.append(first[1:], len(code))
        least = np.array([score[a:b].min() for a, b in zip(first, ends, strict=True)])
        better = np.zeros(len(code), dtype=np.int64)
        for rows, scores in _scored_slices(batches, q, methods):
            docs = rows["doc_id"].to_numpy()
            for c, a, b, low in zip(codes, first, ends, least, strict=True):
                near = np.flatnonzero(scores[c] >= low - APART)
                mine, its = score[a:b], np.round(scores[c][near], SCORE_DIGITS)
                # in order of score and id, a mark ahead of the item that it is itself
                item = np.repeat([False, True], [b - a, len(near)])
                order = np.lexsort((item, np.r_[doc_id[a:b], docs[near]], -np.r_[mine, its]))
                ahead = np.cumsum(item[order])
                marked = ~item[order]
                better[a + order[marked]] += ahead[marked]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(code))), pa.array(better)], ["slot", "better"])

    return run


def scan_entries(shared, methods: list[str], budget: int):
    """The task over index entries, each document's together and terms by their number in the block: the same scores,
    without its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = QueryBlock(**shared.value)
        best = BestRows(len(methods) * len(q.ids), budget, ["doc_id"])
        step = q.slice_rows(len(methods))

        def score(rows: pa.Table) -> None:
            doc, item = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
            term = rows["number"].to_numpy().astype(np.int64)
            # one order of adding up, whatever the order of arrival
            order = np.lexsort((term, item))
            item, term = item[order], term[order]
            tf, length = rows["tf"].to_numpy()[order], rows["doc_len"].to_numpy()[order].astype(float)
            bounds = np.searchsorted(item, np.arange(0, len(doc) + step, step))
            for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                some = doc[part * step : (part + 1) * step]
                scores = _scores(
                    len(some), item[lo:hi] - part * step, term[lo:hi], tf[lo:hi], length[lo:hi], q, methods
                )
                best.offer(pa.table({"doc_id": some, "cost": np.ones(len(some), dtype=np.int64)}), scores)

        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column("doc_id").to_numpy()
            # the last document may go on in the next batch
            cut = int(np.searchsorted(docs, docs[-1]))
            if cut or (open_ and open_[-1].column("doc_id")[-1].as_py() != docs[0]):
                score(pa.Table.from_batches([*open_, batch.slice(0, cut)]))
                open_ = []
            open_.append(batch.slice(cut))
        if open_:
            score(pa.Table.from_batches(open_))
        yield from _named(best.result(), q, methods)

    return run
