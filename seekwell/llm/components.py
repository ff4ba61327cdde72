"""Connected components of a graph given by its edges, by alternating large and small stars.

A large star hangs every larger neighbour of a node on the smallest of its neighbourhood, a small star the node
and its smaller neighbours. Both keep what is connected, and together they end in stars around each component's smallest
node (Kiveris et al. 2014). Nothing is gathered by the driver but one count and checksum a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import written
from seekwell.operators.joins import join_facts


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect the same nodes: each node of a component with its smallest one."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b. A node may have any number of neighbours: the least of them is
    found by a partial aggregate and joined with care for hot keys."""
    if large:
        rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = written(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    joined = join_facts(rows.where("v > u") if large else rows, least, "u", "n", F.col("v"))
    pairs = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:  # the node itself hangs on the least one too
        pairs = pairs.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return written(pairs.where("a <> b").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (long columns a and b, any direction): root is the least node of its component.

    Loops, repeated edges and edges with a null are allowed and change nothing; no edges give no rows. A node
    that is named only in a loop has no row.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = tuple(now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        now = _star(_star(now, large=True), large=False)
