"""Best rows per query under a budget: inside a task, and across tasks.

A row has a score and a cost. In order of score (ties by id) a query keeps rows
while the costs so far stay within its budget; with cost 1 that is plain top-k.

Any subset of the rows may be cut on its own first, by "cost of the better rows
< budget": a row has no more better rows in the subset than in the whole, so
nothing that the whole needs is lost, and the first row that overflows is kept
as well, so that no worse but cheaper row can slip past it later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6
# scores further apart than this differ after rounding as well
APART = 2 * 10.0**-SCORE_DIGITS


class BestRows:
    """What a task keeps of the rows it has scored so far, for every query."""

    def __init__(self, n_queries: int, budget: int, ids: list[str], max_pending: int | None = None):
        self.budget, self.ids = budget, ids
        self.max_pending = max(1 << 14, n_queries * budget) if max_pending is None else max_pending
        # the last row that stays of a query that is full: no row behind it matters
        self.bar = np.full(n_queries, -np.inf)
        self.bar_ids = [np.zeros(n_queries, dtype=np.int64) for _ in ids]
        self.kept: list[pa.Table] = []
        self.pending = 0

    def offer(self, rows: pa.Table, scores: np.ndarray, other: np.ndarray | None = None) -> None:
        """`scores` is queries x rows, not yet rounded, -inf where a row is no match; `other`, of the same
        shape, is a second score that goes along in a column of that name."""
        n_queries, n = scores.shape
        if not n:
            return
        near = scores >= (self.bar - APART)[:, None]
        if n > self.budget and np.count_nonzero(near) > 2 * n_queries * self.budget:
            # costs are at least 1, so at most `budget` rows of these can stay
            cut = n - self.budget
            least = np.partition(scores, cut, axis=1)[:, cut]
            near &= scores >= (least - APART)[:, None]
        query, row = np.divmod(np.flatnonzero(near), n)
        self.offer_pairs(rows, query, row, scores[query, row], None if other is None else other[query, row])

    def offer_pairs(
        self, rows: pa.Table, query: np.ndarray, row: np.ndarray, scores: np.ndarray, other: np.ndarray | None = None
    ) -> None:
        """The same for some pairs: of `rows`, number `row` scores `scores` for `query`, and `other` goes along."""
        score = np.round(scores, SCORE_DIGITS)
        stay = (score > -np.inf) & ((score > self.bar[query]) | self._ties_ahead(rows, query, row, score))
        query, row, score = query[stay], row[stay], score[stay]
        if not len(query):
            return
        other = None if other is None else other[stay]
        picked = rows.take(pa.array(row))
        picked = picked.append_column("query", pa.array(query))
        picked = picked.append_column("score", pa.array(score))
        if other is not None:
            picked = picked.append_column("other", pa.array(np.round(other, SCORE_DIGITS)))
        self.kept.append(picked)
        self.pending += len(query)
        if self.pending > self.max_pending:
            self._compact()

    def _ties_ahead(self, rows: pa.Table, query, row, score) -> np.ndarray:
        """Of the rows that score just what the bar does, those that come first by id."""
        ahead = np.zeros(len(query), dtype=bool)
        open_ = score == self.bar[query]
        for name, bar in zip(self.ids, self.bar_ids, strict=True):
            mine, its = rows[name].to_numpy()[row], bar[query]
            ahead |= open_ & (mine < its)
            open_ &= mine == its
        return ahead

    def _compact(self) -> None:
        rows = pa.concat_tables(self.kept)
        query, score = rows["query"].to_numpy(), rows["score"].to_numpy()
        cost = rows["cost"].to_numpy()
        ids = [rows[name].to_numpy() for name in reversed(self.ids)]
        order = np.lexsort((*ids, -score, query))
        query, score, cost = query[order], score[order], cost[order]
        first = np.r_[True, query[1:] != query[:-1]]
        total = np.cumsum(cost)
        better = total - cost
        better -= better[first][np.cumsum(first) - 1]
        stay = better < self.budget
        full = stay & (better + cost >= self.budget)
        self.bar[query[full]] = score[full]
        for bar, mine in zip(self.bar_ids, reversed(ids), strict=True):
            bar[query[full]] = mine[order][full]
        self.kept = [rows.take(pa.array(order[stay]))]
        # counts new rows only: those that stay are at most `budget` per query
        self.pending = 0

    def result(self) -> pa.Table | None:
        if not self.kept:
            return None
        self._compact()
        return self.kept[0]


def merge_best(df: DataFrame, query: list[str], ids: list[str], budget: int) -> DataFrame:
    """The final rows of every query, from what the tasks kept, with their rank.

    Tasks grow with the data, and so do a query's rows here. They are first cut
    in as many parts as there are shuffle partitions, so that one query is never
    one task's work.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), *ids]
    part = Window.partitionBy(*query, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*query).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        df.withColumn("part", F.spark_partition_id() % parts)
        .withColumn("used", F.sum("cost").over(part))
        .where(F.col("used") - F.col("cost") < budget)
        .drop("part")
    )
    return (
        cut.withColumn("used", F.sum("cost").over(whole))
        .withColumn("rank", F.row_number().over(whole).cast("long"))
        .where(F.col("used") <= budget)
    )
