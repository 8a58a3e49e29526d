"""Connected components of an edge table, without leaving the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgauge.llm.common import stash, stash_map, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node points its larger (or its smaller) neighbours, and itself, at its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Edges that one task closes by itself; more are closed part by part, then by star rounds over the parts' forests.
EDGES_A_TASK = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0..n-1 that the edges (a, b) connect each node with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):  # roots hook on to the least label that an edge shows them
            np.minimum.at(new, label[side], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            return label
        label = new


def _forest(batches):
    """Rows (a, b) of a part -> every node with the least node that the part's edges connect it with."""
    import pyarrow as pa

    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = least_reachable(where[: len(a)], where[len(a) :], len(nodes))
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], names=["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 40, edges_a_task: int = EDGES_A_TASK, most: int | None = None) -> DataFrame:
    """node, component (its least node) of every node in an edge (a, b); self-loops are nodes of their own.

    Every part of at most about edges_a_task edges becomes a forest of stars; several parts' forests are merged by
    alternating large and small stars, whose edges are written to the shared folder each round. most: a bound on the edges.
    """
    edges = stash(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges", most)
    parts = max(1, -(-edges.count() // edges_a_task))
    forest = stash_map(edges.repartition(parts), _forest, "a long, b long", "forest")
    if parts == 1:
        return forest.toDF("node", "component")
    nodes = forest.select(F.col("a").alias("node")).distinct()
    now = stash(forest.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    for _ in range(rounds):
        new = stash(_star(_star(now, True), False), "edges")
        same = new.agg(*mark).first() == now.agg(*mark).first()
        unstash(now)
        now = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
