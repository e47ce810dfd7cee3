"""k-means: deterministic start, Lloyd rounds, mini-batches with or without accumulated sums.

Centroids are a small matrix on the driver (its size is checked) that each round sends to the
executors; a round is one pass in which every task sums its vectors by nearest centroid, and
the tasks' sums are added list by list. Sums are integers on a binary grid chosen from the data's range and count, so they don't depend
on the order in which tasks finish: a fit is the same on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.kernels import lists, matrix, nearest
from nearfield.operators.knn import with_position_ids

#: Most bytes of centroids (as doubles).
MOST_BYTES = 1 << 30
#: Rows that a top-k may gather in one task.
TOP_K = 20_000
MODES = ("legacy", "accumulated")


def hashed(seed: int | None) -> Column:
    """What rows are sampled by: their id or, with a seed, its hash."""
    return F.col("id").cast("long") if seed is None else F.xxhash64(F.col("id"), F.lit(seed))


def first_rows(vectors: DataFrame, count: int, seed: int | None = None) -> DataFrame:
    """``count`` rows: those of lowest id or, with a seed, of lowest hash (a sample without replacement).

    A few come from a top-k. For more, histograms of the key's bits, two bytes a pass over the ids
    alone, narrow down where the last row lies; all rows before that range belong to the
    sample, and what is missing is taken from the range itself.
    """
    if count <= TOP_K:
        return vectors.orderBy(hashed(seed), "id").limit(count)
    rows = vectors.withColumn("_key", hashed(seed))
    unsigned = F.col("_key").bitwiseXOR(F.lit(-(1 << 63)))
    prefix, missing = 0, count
    for shift in (48, 32, 16, 0):
        inside = F.lit(True) if shift == 48 else F.shiftrightunsigned(unsigned, shift + 16) == prefix
        part = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
        sizes = rows.filter(inside).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # 65,536 rows at most
        if shift == 48 and sum(r.n for r in sizes) <= count:
            return vectors
        for r in sizes:
            if r.n > missing:
                break
            missing -= r.n
        prefix, last = prefix << 16 | r.part, r.n
        if last <= 16 * TOP_K or missing <= TOP_K:
            break
    low = (prefix << shift) - (1 << 63)
    high = low + (1 << shift) - 1
    found = rows.filter(F.col("_key") < low)
    if missing:
        rest = rows.filter((F.col("_key") >= low) & (F.col("_key") <= high))
        if missing <= TOP_K:
            rest = rest.orderBy("_key", "id").limit(missing)
        else:  # rows are numbered instead of gathered
            rest = with_position_ids(rest, ["_key", "id"], to="_position").filter(F.col("_position") < missing).drop("_position")
        found = found.unionByName(rest)
    return found.drop("_key")


def start_centroids(vectors: DataFrame, count: int, seed: int | None = None) -> np.ndarray:
    """The vectors of ``count`` rows as first centroids."""
    found = first_rows(vectors.select("id", "vec"), count, seed).toArrow()
    if found.num_rows < count:
        raise ValueError(f"{count} centroids need as many vectors, found {found.num_rows}")
    out = matrix(found["vec"])
    if out.nbytes > MOST_BYTES:
        raise ValueError("the centroids are too large for the driver")
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, count: int = 1) -> DataFrame:
    """``vectors`` with the nearest centroids: cluster_id and centroid_distance, or for ``count`` > 1 arrays of them."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    place = vectors.columns.index("vec")
    kinds = "cluster_id int, centroid_distance double" if count == 1 else "cluster_ids array<int>, centroid_distances array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = nearest(matrix(batch.column(place), sent.value.shape[1]), sent.value, count)
            if count == 1:
                more = [pa.array(ids[:, 0], pa.int32()), pa.array(found[:, 0])]
            else:
                more = [pa.array(list(ids), pa.list_(pa.int32())), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *[k.split()[0] for k in kinds.split(", ")]])

    return vectors.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), kinds]))


def grid_of(vectors: DataFrame) -> float:
    """A power of two: components times this, rounded down, sum up without overflow."""
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x.cast("double"))))).alias("most")).first()
    return grid(found.n or 0, found.most or 0.0)


def grid(count: int, most: float) -> float:
    return 2.0 ** (61 - math.ceil(math.log2(max(count, 2))) - max(0, math.ceil(math.log2(max(most, 1e-9)))))


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of counts ``n`` and of the arrays ``sums`` by some integer ``keys``: each task adds the arrays of all keys dealt to it at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = np.stack([batch.column(i).to_numpy() for i in range(len(keys) + 1)], axis=1).astype(np.int64)
                sums = batch.column(len(keys) + 1).flatten().to_numpy().reshape(batch.num_rows, -1)
                if held is not None:
                    own, sums = np.concatenate([held[0], own]), np.concatenate([held[1], sums])
                order = np.lexsort(own[:, :-1].T[::-1])
                own = own[order]
                edges = np.flatnonzero(np.concatenate([[True], (own[1:, :-1] != own[:-1, :-1]).any(1)]))
                added = np.add.reduceat(own[:, -1], edges)
                held = np.column_stack([own[edges, :-1], added]), np.add.reduceat(sums[order], edges, axis=0)
        if held is not None:
            own, sums = held
            yield pa.RecordBatch.from_arrays([*(pa.array(own[:, i], pa.int32()) for i in range(len(keys))), pa.array(own[:, -1]), lists(sums, pa.int64())], names=[*keys, "n", "sums"])

    return rows.repartition(*keys).mapInArrow(run, rows.schema)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, scale: float) -> DataFrame:
    """For each centroid that is nearest to some vector: cluster_id, n, and sums on the grid."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        sums, counts = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0), centroids.shape[1])
                own = nearest(rows, centroids)[0][:, 0]
                order = np.argsort(own, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
                which = own[order][edges]
                sums[which] += np.add.reduceat(np.floor(rows[order] * scale).astype(np.int64), edges, axis=0)
                counts += np.bincount(own, minlength=len(centroids))
        which = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(counts[which]), lists(sums[which], pa.int64())], names=["cluster_id", "n", "sums"])

    return summed(vectors.select("vec").mapInArrow(run, "cluster_id int, n bigint, sums array<bigint>"), ["cluster_id"])


def histogram(assigned: DataFrame, clusters: int) -> DataFrame:
    """cluster_id, n for every cluster, also empty ones."""
    every = assigned.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def batches_of(vectors: DataFrame, size: int, rounds: int, seed: int | None) -> list[DataFrame]:
    """Each round's mini-batch: consecutive windows of ``size`` rows in the order of ids (with a seed, of their hashes), from the start again after the last row.

    Only rows of some window are sorted and written, once for all rounds.
    """
    total = vectors.count()
    used = min(total, size * rounds)
    rows = vectors if used == total else first_rows(vectors, used, seed)
    numbered = with_position_ids(rows.withColumn("_key", hashed(seed)), ["_key", "id"], to="_position").drop("_key")
    return [numbered.filter(F.pmod(F.col("_position") - F.lit(n * size), F.lit(total)) < size).drop("_position") for n in range(rounds)]


def kmeans(vectors: DataFrame, count: int, rounds: int = 20, seed: int | None = 0, tol: float = 1e-4, minibatch: int | None = None, mode: str = "legacy", start: np.ndarray | None = None) -> np.ndarray:
    """Centroids after at most ``rounds`` rounds; an empty cluster keeps its old centroid.

    ``minibatch`` rounds see that many rows each (see ``batches_of``). In the mode
    "accumulated" the sums of all such rounds count; with full rounds the modes are the same.
    """
    if mode not in MODES:
        raise ValueError("mode must be 'legacy' or 'accumulated'")
    vectors = vectors.select("id", "vec")
    centroids = start_centroids(vectors, count, seed) if start is None else np.asarray(start, dtype=np.float64)
    scale = grid_of(vectors)
    full = minibatch is None or minibatch >= vectors.count()
    batches = [vectors] * rounds if full else batches_of(vectors, minibatch, rounds, seed)
    all_sums, all_counts = [[0] * centroids.shape[1] for _ in range(len(centroids))], [0] * len(centroids)
    for seen in batches:
        new = centroids.copy()
        for row in cluster_sums(seen, centroids, scale).collect():  # one row for each centroid
            sums, size = row.sums, row.n
            if mode == "accumulated" and not full:
                sums = all_sums[row.cluster_id] = [a + b for a, b in zip(all_sums[row.cluster_id], sums)]
                size = all_counts[row.cluster_id] = all_counts[row.cluster_id] + size
            new[row.cluster_id] = np.array([float(s) for s in sums]) / scale / size
        shift = np.abs(new - centroids).max(initial=0)
        centroids = new
        if shift < tol:
            break
    return centroids
