"""Inverted-file search: coarse lists, product-quantised postings, exact reranking.

A posting is ``[cluster_id, id, codes, vec?]``. Centroids and codebooks are small and go to every
executor; postings stay where they are: a search routes the queries, reads only the
lists that some query probes (of a stored index only the files of their ranges), scores them where they are read, and shuffles just each
task's shortlist. A shortlist that can hold all records of the probed lists cuts nothing: such a search keeps
the k nearest by exact distance at once. One that a task can't keep is left to Spark to rank. Routing is distributed and its pairs of a query and a list are counted before
any are gathered: a search is asked in sets of queries whose vectors stay under
``BROADCAST_BYTES`` and whose pairs under ``MOST_PAIRS``, each an array of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.clustering import MODES, assign, first_rows, histogram, kmeans
from nearfield.operators.kernels import Best, Nearest, exact, lists, matrix, nearest, running_sum
from nearfield.operators.knn import BROADCAST_BYTES, best, check_k
from nearfield.operators.quantize import ProductQuantizer, checked_queries, looked_up

PQ_MODES, BACKENDS, PROBES = ("standard", "residual"), ("arrow", "numpy", "mlx"), 8
#: Pairs of a query and a list, as two 32-bit numbers, that are gathered and sent at a time.
MOST_PAIRS = 1 << 24
#: Distance tables of all queries that a task keeps, where they don't depend on the list.
TABLE_BYTES = 128 << 20
#: Rows of all queries' shortlists that a task keeps, and pairs of a query and a record that it scores at a time.
SHORT_ROWS, PAIRS = 1 << 21, 1 << 17
#: Lists beyond which a probe filter is a broadcast table instead of literals.
LITERALS = 2000


@dataclass
class IvfConfig:
    dim: int
    nlist: int
    pq_m: int = 16
    pq_k: int = 256
    seed: int | None = 0
    store_full_vectors: bool = False
    routing_backend: str = "arrow"
    pq_mode: str = "standard"
    coarse_training: str = "legacy"

    def __post_init__(self) -> None:
        if self.dim <= 0 or self.nlist <= 0:
            raise ValueError("dim and nlist must be positive")
        if self.pq_mode not in PQ_MODES:
            raise ValueError("pq_mode must be 'standard' or 'residual'")
        if self.routing_backend not in BACKENDS:
            raise ValueError(f"routing_backend must be one of {BACKENDS}; all have the same plan")
        if self.coarse_training not in MODES:
            raise ValueError("coarse_training must be 'legacy' or 'accumulated'")
        ProductQuantizer(self.dim, self.pq_m, self.pq_k)


@dataclass
class IvfPq:
    """An inverted file: configuration, centroids, quantiser; postings are a DataFrame."""

    config: IvfConfig
    centroids: np.ndarray | None = None
    pq: ProductQuantizer | None = None
    postings: DataFrame | None = None
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: The postings of some lists, where a store can read them alone.
    source: Callable[[np.ndarray], DataFrame] | None = None

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    def _trained(self) -> None:
        if not self.is_trained:
            raise RuntimeError("the index is not trained")

    def train(self, vectors: DataFrame, rounds: int = 20, minibatch: int | None = None, tol: float = 1e-4, pq_sample: int | None = None, pq_rounds: int = 15) -> IvfPq:
        """Coarse k-means, then the quantiser on vectors or residuals; drops all postings."""
        c = self.config
        vectors = vectors.select("id", "vec")
        self.centroids = kmeans(vectors, c.nlist, rounds, c.seed, tol, minibatch, c.coarse_training)
        if self.centroids.shape[1] != c.dim:
            raise ValueError(f"expected {c.dim} components, found {self.centroids.shape[1]}")
        sample = vectors if pq_sample is None else first_rows(vectors, pq_sample, (c.seed or 0) + 10_007)
        self.pq = ProductQuantizer(c.dim, c.pq_m, c.pq_k, c.seed).train(self.residuals(sample) if c.pq_mode == "residual" else sample, pq_rounds)
        self.postings, self.source, self.sizes = None, None, np.zeros(c.nlist, np.int64)
        return self

    def residuals(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` [id, vec] less their nearest centroids."""
        centroids = self.centroids
        sent = vectors.sparkSession.sparkContext.broadcast(centroids)

        def run(rows: pa.Array) -> pa.Array:
            own = matrix(rows, sent.value.shape[1])
            out = own - sent.value[nearest(own, sent.value)[0][:, 0]]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return vectors.select("id", F.arrow_udf(run, "array<double>")("vec").alias("vec"))

    def encoded(self, vectors: DataFrame) -> DataFrame:
        """Postings of ``vectors`` [id, vec]."""
        self._trained()
        keep = self.config.store_full_vectors
        sent = vectors.sparkSession.sparkContext.broadcast((self.centroids, self.pq, self.config.pq_mode, self.config.dim))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, pq, mode, dim = sent.value
            for batch in batches:
                rows = matrix(batch.column(1), dim)
                own = nearest(rows, centroids)[0][:, 0]
                codes = pq.codes_of(rows - centroids[own] if mode == "residual" else rows)
                columns = [pa.array(own, pa.int32()), batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * pq.m, pa.int32()), pa.array(codes.ravel(), pa.int16()))]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(1)] if keep else columns, names=["cluster_id", "id", "codes", "vec"][: 3 + keep])

        schema = "cluster_id int, id bigint, codes array<smallint>" + (f", vec {vectors.schema['vec'].dataType.simpleString()}" if keep else "")
        return vectors.select(F.col("id").cast("long"), "vec").mapInArrow(run, schema)

    def add(self, vectors: DataFrame) -> IvfPq:
        """Append; ids need not be unique."""
        new = self.encoded(vectors)
        self.postings = new if self.postings is None else self.postings.unionByName(new)
        self.sizes = self.sizes + sizes_of(new, self.config.nlist)
        return self

    def probes(self, queries: DataFrame, nprobe: int | None = None, max_candidates: int | None = None) -> DataFrame:
        """Lists to read for each query: [q_id, probe, cluster_id, centroid_distance, n], nearest first.

        ``nprobe`` nearest lists, or the fewest nearest ones that hold ``max_candidates`` records.
        """
        self._trained()
        check_routing(nprobe, max_candidates)
        count = min(PROBES if nprobe is None else nprobe, self.config.nlist)
        sent = queries.sparkSession.sparkContext.broadcast((self.centroids, self.sizes))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, sizes = sent.value
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    batch = whole.slice(start, 1024)
                    ids, found = nearest(matrix(batch.column(1), centroids.shape[1]), centroids, count if max_candidates is None else len(centroids))
                    held = sizes[ids]
                    use = np.ones(ids.shape, dtype=bool) if max_candidates is None else np.cumsum(held, axis=1) - held < max_candidates
                    row, probe = np.nonzero(use)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(probe + 1, pa.int32()), pa.array(ids[use], pa.int32()), pa.array(found[use]), pa.array(held[use])],
                        names=["q_id", "probe", "cluster_id", "centroid_distance", "n"],
                    )

        return queries.select("q_id", "q").mapInArrow(run, "q_id bigint, probe int, cluster_id int, centroid_distance double, n bigint")

    def scanned(self, queries: DataFrame, nprobe: int | None = None, max_candidates: int | None = None) -> DataFrame:
        """Records in each query's lists: [q_id, lists, scanned]."""
        return self.probes(queries, nprobe, max_candidates).groupBy("q_id").agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("scanned"))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, max_candidates: int | None = None, rerank: int = 0) -> DataFrame:
        """[q_id, rank, id, distance]: the k nearest by codes or, with ``rerank`` = r, the exact k nearest of the max(k, r) nearest by codes."""
        check_k(k, rerank=rerank)
        self._trained()
        check_routing(nprobe, max_candidates)
        if rerank and self.postings is not None and self._most(nprobe) <= max(k, rerank):
            return self._found(queries, k, nprobe, max_candidates, True, True).select("q_id", "rank", "id", "distance")
        found = self.shortlist(queries, max(k, rerank), nprobe, max_candidates, bool(rerank))
        if rerank:
            found = best(found.withColumn("distance", F.col("exact")), k)
        return found.filter(F.col("rank") <= k).select("q_id", "rank", "id", "distance")

    def shortlist(self, queries: DataFrame, size: int, nprobe: int | None = None, max_candidates: int | None = None, rerank: bool = False) -> DataFrame:
        """[q_id, rank, id, distance, exact] of the ``size`` nearest by codes."""
        self._trained()
        check_routing(nprobe, max_candidates)
        if self.postings is None:
            if rerank:
                self._reranked()
            return queries.sparkSession.createDataFrame([], "q_id bigint, rank int, id bigint, distance double, exact double")
        return self._found(queries, size, nprobe, max_candidates, rerank)

    def _reranked(self) -> None:
        if not self.config.store_full_vectors:
            raise ValueError("reranking needs an index with store_full_vectors")

    def _most(self, nprobe: int | None) -> int:
        """As many records as any query's lists can hold: a shortlist of that size cuts nothing, whatever the codes."""
        return int(np.sort(self.sizes)[::-1][:nprobe].sum())

    def _found(self, queries: DataFrame, size: int, nprobe: int | None, max_candidates: int | None, rerank: bool, whole: bool = False) -> DataFrame:
        """[q_id, rank, id, distance, exact] of the ``size`` nearest by codes, or by exact distance if the ``whole`` lists are reranked."""
        if rerank:
            self._reranked()
        size = min(size, max(1, self._most(nprobe)))
        count = queries.count()
        pairs = count * min(PROBES if nprobe is None else nprobe, self.config.nlist) if max_candidates is None else self.probes(queries, None, max_candidates).count()
        sets = max(-(-count * self.config.dim * 8 // BROADCAST_BYTES), -(-pairs // MOST_PAIRS))
        parts = [queries] if sets <= 1 else [queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(sets)) == s) for s in range(sets)]
        return best(reduce(DataFrame.unionByName, [self._scan(part, size, nprobe, max_candidates, rerank, whole) for part in parts]), size)

    def _scan(self, queries: DataFrame, size: int, nprobe: int | None, max_candidates: int | None, rerank: bool, whole_lists: bool) -> DataFrame:
        query_ids, rows = checked_queries(queries, self.config.dim)
        spark = queries.sparkSession
        numbered = spark.createDataFrame(pa.table({"q_id": np.arange(len(query_ids)), "q": lists(rows, pa.float64())}), "q_id bigint, q array<double>") if len(rows) else queries
        routed = self.probes(numbered, nprobe, max_candidates).select(F.col("q_id").cast("int"), "cluster_id").toArrow()  # numbers of queries and lists
        who, of = routed["q_id"].to_numpy(), routed["cluster_id"].to_numpy()
        order = np.lexsort((who, of))
        asked, starts = np.unique(of[order], return_index=True)
        sent = spark.sparkContext.broadcast((query_ids, rows, (asked, np.append(starts, len(who)), who[order]), self.pq, self.centroids if self.config.pq_mode == "residual" else None))
        postings = self.source(asked) if self.source else probed(self.postings, asked)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, rows, (asked, starts, every), pq, centroids = sent.value
            held = len(rows) * size <= SHORT_ROWS
            state = Nearest(rows, size, "l2") if whole_lists and held else Best(len(rows), size if held else 0, np.float64)
            whole = pq.tables(rows) if centroids is None and len(rows) * pq.m * pq.k * 8 <= TABLE_BYTES else None
            for batch in batches:
                found_lists = batch.column(0).to_numpy()
                order = np.argsort(found_lists, kind="stable")
                batch, found_lists = batch.take(pa.array(order)), found_lists[order]
                edges = np.flatnonzero(np.concatenate([[True], np.diff(found_lists) != 0])) if len(found_lists) else []
                for start, stop in zip(edges, [*edges[1:], len(found_lists)]):
                    c = int(found_lists[start])
                    place = int(np.searchsorted(asked, c))
                    if place == len(asked) or asked[place] != c:
                        continue
                    who = every[starts[place] : starts[place + 1]]
                    part = batch.slice(start, stop - start)
                    ids, raw = part.column(1).to_numpy(), matrix(part.column(3), rows.shape[1]) if rerank else None
                    if whole_lists and held:
                        state.add(ids, raw, who=who)
                        continue
                    codes = matrix(part.column(2), pq.m).astype(np.int64)
                    step = max(1, min(256, PAIRS // len(ids)))
                    for at in range(0, len(who), step):
                        own = who[at : at + step]
                        table = whole[own] if whole is not None else pq.tables(rows[own] - centroids[c] if centroids is not None else rows[own])
                        found = looked_up(table, codes)
                        if not held:  # too many to keep: Spark ranks them all
                            points = rows[own]
                            more = running_sum((points[:, i, None] - raw[:, i]) ** 2 for i in range(points.shape[1])) if rerank else np.zeros(found.shape)
                            columns = np.repeat(query_ids[own], len(ids)), np.tile(ids, len(own)), (more if whole_lists else found).ravel(), more.ravel()
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_id", "id", "distance", "exact"])
                            continue
                        which, record = np.nonzero(found <= state.distances[own, -1:])
                        more = exact(rows[own[which]], raw[record], "l2") if rerank else np.zeros(len(which))
                        state.keep(own[which], ids[record], more, found[which, record])
            q, ids, more, distances = state.table(query_ids)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(distances), pa.array(distances if whole_lists else more)], names=["q_id", "id", "distance", "exact"])

        columns = ["cluster_id", "id", "codes", *["vec"] * rerank]
        return postings.select(*columns).mapInArrow(run, "q_id bigint, id bigint, distance double, exact double")


def check_routing(nprobe: int | None, max_candidates: int | None) -> None:
    if nprobe is not None and max_candidates is not None:
        raise ValueError("give nprobe or max_candidates, not both")
    if (nprobe is not None and nprobe <= 0) or (max_candidates is not None and max_candidates <= 0):
        raise ValueError("nprobe and max_candidates must be positive")


def probed(postings: DataFrame, asked: np.ndarray) -> DataFrame:
    """The postings of some lists."""
    if len(asked) <= LITERALS:
        return postings.filter(F.col("cluster_id").isin([int(c) for c in asked]))
    wanted = postings.sparkSession.createDataFrame(pa.table({"cluster_id": pa.array(asked, pa.int32())}), "cluster_id int")
    return postings.join(F.broadcast(wanted), "cluster_id", "left_semi")  # at most one row for each list


def sizes_of(postings: DataFrame, nlist: int) -> np.ndarray:
    out = np.zeros(nlist, dtype=np.int64)
    for row in histogram(postings, nlist).collect():  # one row for each list
        out[row.cluster_id] = row.n
    return out


def replicated(assigned: DataFrame, count: int) -> DataFrame:
    """Primary list of every record, and the second list too of the ``count`` records of least margin.

    ``assigned`` has id and the two nearest lists as cluster_ids and centroid_distances.
    """
    from nearfield.functions.vectors import boundary_margin

    margin = boundary_margin(F.col("centroid_distances")[0], F.col("centroid_distances")[1])
    first = assigned.select("id", F.col("cluster_ids")[0].alias("cluster_id"))
    second = assigned.select("id", F.col("cluster_ids")[1].alias("cluster_id"), margin.alias("margin")).orderBy("margin", "id").limit(count)
    return first.unionByName(second.select("id", "cluster_id"))


def candidates(lists: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct (q_id, id) of the records in each query's probed lists."""
    return probes.select("q_id", "cluster_id").join(lists.select("id", "cluster_id"), "cluster_id").select("q_id", "id").distinct()


def margins(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """[id, cluster_ids, centroid_distances]: the two nearest lists of each vector."""
    return assign(vectors.select("id", "vec"), centroids, 2).drop("vec")
