"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows of each pair (a, b), and all of their classes, one label: the smallest row. In place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being its smallest node.

    Alternates two steps until the edges stop changing: every node hangs its larger neighbours under
    its smallest neighbour, then its smaller ones. Distances to the root about halve each round. Each
    round is written to the shared folder and the one before deleted, so a lost executor costs one round
    at most, and needs only
    a minimum per node, which is combined before the shuffle; the join with it may split hot nodes.
    Nodes without edges do not appear; self-loops and repeated edges are allowed.
    """
    edge = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edge, last = shared.materialize(edge, name), None
    for _ in range(most_rounds):
        before = edge
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared.materialize(large.distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        edge = shared.materialize(small.distinct(), name)
        state = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        shared.discard(large)
        shared.discard(before)
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = edge.select(F.col("v").alias("node")).distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
