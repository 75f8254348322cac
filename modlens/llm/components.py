"""Connected components of an edge table, in rounds of local union-find, joins and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.session import checkpointed

# Edges that one task joins by itself.
EDGES_PER_TASK = 1_000_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node each is connected to by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        # Roots of both ends point to the smaller label, then every node to its root's.
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    # Each task's edges become stars around the smallest node they connect.
    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if parts:
            a, b = (np.concatenate(c) for c in zip(*parts))
            node, root = union(a, b)
            off = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(root[off])], ["a", "b"])

    return edges.repartition(tasks).mapInArrow(run, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    # Large star: larger neighbours move to the smallest neighbour; small star: smaller ones do.
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = moved.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each task first joins the edges it has, as many tasks as the edges ask for. Where that is one,
    all is done; else the stars that the tasks made are joined by alternating large-star and
    small-star steps until nothing changes, each round written to the shared folder. A node's
    edges are summed per partition before they are shuffled. Loops and repeated edges do no harm;
    no edges give no rows.
    """
    now = checkpointed(edges.select("a", "b").filter("a <> b"))
    tasks = max(1, -(-now.count() // edges_per_task))
    now = checkpointed(_contracted(now, tasks))
    before = None
    while tasks > 1 and (state := _state(now)) != before:
        before = state
        now = checkpointed(_star(_star(now, large=True), large=False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
