"""Connected components by alternating stars: every round is a join and an aggregation.

Before the rounds each task replaces the edges it reads by stars around their least nodes (union by
least label in NumPy), ``SHARE`` edges at a time. A round costs the driver some ten jobs, whatever
the size of the table, so there is none where the edges are stars already, as those of one share are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.shared import release, settled

#: Edges that a task contracts at a time (30 MB at its peak).
SHARE = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not its component's least one, and that least one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    label, (a, b) = np.arange(len(nodes)), ends.reshape(2, -1)
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a task's edges; of more than ``SHARE``, of so many at a time and the stars so far."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate(c) for c in zip(*held)))

    def batch(edges: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in edges], names=["u", "v"])

    for own in batches:
        held.append((own.column(0).to_numpy(), own.column(1).to_numpy()))
        size += own.num_rows
        if size >= SHARE:
            held = [joined()]
            size = len(held[0][0])
            if size >= SHARE // 2:
                yield batch(held[0])
                held, size = [], 0
    if held:
        yield batch(joined())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one centre (a centre itself), so that a round would change nothing."""
    centres = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v"))
    return not centres.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high").count()


def components(edges: DataFrame) -> DataFrame:
    """For each node ``u`` of the edges (u, v) that is not its component's least one: (u, v = least).

    Rounds end when the edges, which lead from a larger node to a smaller one, are stars.
    """
    found = settled(edges.filter("u <> v").select("u", "v"))
    shares = max(1, -(-found.count() // SHARE))
    contracted = found.coalesce(shares).mapInArrow(_contracted, "u bigint, v bigint")
    edges = settled(contracted.distinct() if shares > 1 else contracted)
    release(found)
    while not _are_stars(edges):
        last, edges = edges, settled(_small_star(_large_star(edges)))
        release(last)
    return edges
