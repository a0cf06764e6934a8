"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

#: Children of a node in the trees that stand for components found inside a task: no node gets many edges.
FAN = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): the label is the least node that it can reach.

    Each round takes the least label among neighbours and then the label of that label, so a chain of n
    nodes takes about log n rounds.  Rounds end when no label changes; each is written to the checkpoint
    folder.  Labels that many nodes share are looked up by `join_few`, not in one task.
    """
    pairs = edges.select("a", "b")
    both = tk.cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tk.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while not labels.isEmpty():
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        lower = tk.cut(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        if lower.filter("label <> old").isEmpty():
            break
        # only labels that aren't their own label lead on
        on = lower.filter("label <> node").select(F.col("node").alias("label"), F.col("label").alias("next")).join(lower.select("label").distinct(), "label", "left_semi")
        jumped = tk.join_few(lower.select("node", "label"), on, ["label"], "node", "left")
        labels = tk.cut(jumped.select("node", F.coalesce("next", "label").alias("label")))
    return labels


def forest(near, n: int) -> list[np.ndarray]:
    """Components of n nodes, those of two or more; near(i, others) tells which of others are joined to i."""
    left, out = np.arange(n), []
    while len(left):
        part, left = [int(left[0])], left[1:]
        at = 0
        while at < len(part) and len(left):
            hit = near(part[at], left)
            part += left[hit].tolist()
            left = left[~hit]
            at += 1
        if len(part) > 1:
            out.append(np.array(part))
    return out


def tree_edges(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a tree over the nodes of a component."""
    i = np.arange(1, len(part))
    return part[i], part[(i - 1) // FAN]
