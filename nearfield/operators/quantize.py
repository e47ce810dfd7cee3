"""Product quantisation: codebooks, codes, distance tables and a flat search over codes.

Codebooks (subspace, code, component) are ``dim * k`` doubles, small on the driver and sent
to executors; codes are ``array<smallint>``, since Spark has no unsigned byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.clustering import first_rows, grid_of, start_centroids, summed
from nearfield.operators.kernels import Best, lists, matrix, nearest, running_sum
from nearfield.operators.knn import BROADCAST_BYTES, best, check_k

MOST_CODES = 256
#: Distance tables that a task holds at a time, and records that they are looked up for.
TABLE_BYTES, RECORDS = 128 << 20, 1 << 16


@dataclass
class ProductQuantizer:
    """Configuration and, once trained, codebooks."""

    dim: int
    m: int = 16
    k: int = 256
    seed: int | None = 0
    codebooks: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.dim <= 0 or self.m <= 0 or self.k <= 0 or self.dim % self.m:
            raise ValueError("m must be positive and divide dim, and k positive")
        if self.k > MOST_CODES:
            raise ValueError(f"k must be at most {MOST_CODES}")

    @property
    def width(self) -> int:
        return self.dim // self.m

    def compression_ratio(self) -> float:
        """Bytes of a float vector over those of its codes."""
        return 4 * self.dim / self.m

    def _trained(self) -> np.ndarray:
        if self.codebooks is None:
            raise RuntimeError("the quantiser is not trained")
        return self.codebooks

    def train(self, vectors: DataFrame, rounds: int = 15, tol: float = 1e-4, sample: int | None = None) -> ProductQuantizer:
        """An independent k-means in each subspace; one pass over the data serves all of them."""
        vectors = vectors.select("id", "vec")
        if sample is not None:
            vectors = first_rows(vectors, sample, self.seed)
        start = start_centroids(vectors, self.k, self.seed)
        if start.shape[1] != self.dim:
            raise ValueError(f"expected {self.dim} components, found {start.shape[1]}")
        books = start.reshape(self.k, self.m, self.width).transpose(1, 0, 2).copy()
        scale, open_ = (grid_of(vectors), np.ones(self.m, dtype=bool)) if rounds else (1.0, np.zeros(self.m, dtype=bool))
        for _ in range(rounds):
            new = books.copy()
            for row in self._sums(vectors, books, scale).collect():  # one row for each code
                if open_[row.subspace]:
                    new[row.subspace, row.code] = np.array([float(s) for s in row.sums]) / scale / row.n
            open_ &= np.abs(new - books).max(axis=(1, 2)) >= tol
            books = new
            if not open_.any():
                break
        self.codebooks = books
        return self

    def _sums(self, vectors: DataFrame, books: np.ndarray, scale: float) -> DataFrame:
        sent, m, width = vectors.sparkSession.sparkContext.broadcast(books), self.m, self.width

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = matrix(batch.column(0), m * width)
                    for s in range(m):
                        part = rows[:, s * width : (s + 1) * width]
                        own = nearest(part, books[s])[0][:, 0]
                        np.add.at(sums[s], own, np.floor(part * scale).astype(np.int64))
                        counts[s] += np.bincount(own, minlength=books.shape[1])
            s, c = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(counts[s, c]), lists(sums[s, c], pa.int64())], names=["subspace", "code", "n", "sums"])

        return summed(vectors.select("vec").mapInArrow(run, "subspace int, code int, n bigint, sums array<bigint>"), ["subspace", "code"])

    def codes_of(self, vectors: np.ndarray) -> np.ndarray:
        books = self._trained()
        return np.stack([nearest(vectors[:, s * self.width : (s + 1) * self.width], books[s])[0][:, 0] for s in range(self.m)], axis=1) if len(vectors) else np.zeros((0, self.m), np.int64)

    def encode(self, vec: Column) -> Column:
        """Codes of a vector column."""
        self._trained()
        own = self

        def run(vectors: pa.Array) -> pa.Array:
            return lists(own.codes_of(matrix(vectors, own.dim)), pa.int16())

        return F.arrow_udf(run, "array<smallint>")(vec)

    def decode(self, codes: Column) -> Column:
        """The vector that codes stand for, as doubles."""
        books, m = self._trained(), self.m

        def run(rows: pa.Array) -> pa.Array:
            found = matrix(rows, m).astype(np.int64)
            return lists(np.concatenate([books[s][found[:, s]] for s in range(m)], axis=1), pa.float64())

        return F.arrow_udf(run, "array<double>")(codes)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of each query's sub-vectors to all codes: query, subspace, code."""
        books = self._trained()
        parts = queries.reshape(len(queries), self.m, 1, self.width) - books[None]
        return running_sum(parts[..., i] * parts[..., i] for i in range(self.width))

    def code_tables(self) -> np.ndarray:
        """Squared distances between the codes of each subspace: subspace, code, code."""
        books = self._trained()
        parts = books[:, :, None] - books[:, None]
        return running_sum(parts[..., i] * parts[..., i] for i in range(self.width))

    def distance_table(self, query: Column) -> Column:
        """A query column's table as ``array<array<double>>``."""
        own = self

        def run(rows: pa.Array) -> pa.Array:
            found = own.tables(matrix(rows, own.dim))
            return pa.array([list(map(list, t)) for t in found], pa.list_(pa.list_(pa.float64())))

        return F.arrow_udf(run, "array<array<double>>")(query)

    def codebook_table(self, spark: SparkSession) -> DataFrame:
        """The codebooks as rows: subspace, code, centroid."""
        rows = [(s, c, [float(x) for x in v]) for s, book in enumerate(self._trained()) for c, v in enumerate(book)]
        return spark.createDataFrame(rows, "subspace int, code int, centroid array<double>")

    def symmetric_table(self, spark: SparkSession) -> DataFrame:
        """Squared distances between the codes of each subspace: subspace, first, second, distance."""
        from nearfield.functions.vectors import squared_l2

        a = self.codebook_table(spark).withColumnsRenamed({"code": "first", "centroid": "a"})
        b = self.codebook_table(spark).withColumnsRenamed({"code": "second", "centroid": "b"})
        return a.join(b, "subspace").select("subspace", "first", "second", squared_l2(F.col("a"), F.col("b")).alias("distance"))


def symmetric_distance(first: Column, second: Column, codebooks: Column) -> Column:
    """Squared distance of two code columns' vectors; ``codebooks`` is subspace, code, component."""
    from nearfield.functions.vectors import decode, squared_l2

    return squared_l2(decode(first, codebooks), decode(second, codebooks))


def looked_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Table sums of every query (rows) and record (columns), subspaces in order."""
    return running_sum(tables[:, s, :][:, codes[:, s]] for s in range(codes.shape[1]))


def flat_search(encoded: DataFrame, queries: DataFrame, pq: ProductQuantizer, k: int = 10) -> DataFrame:
    """The k records [id, codes] of least table distance for each query [q_id, q]."""
    check_k(k)
    asked = checked_queries(queries, pq.dim)
    sent = encoded.sparkSession.sparkContext.broadcast((*asked, pq))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, rows, own = sent.value
        state, group = Best(len(rows), k), max(1, TABLE_BYTES // (own.m * own.k * 8))
        tables = own.tables(rows) if len(rows) <= group else None

        def look(ids: np.ndarray, codes: np.ndarray) -> None:
            for at in range(0, len(rows), group):
                part = tables if tables is not None else own.tables(rows[at : at + group])
                for start in range(0, len(ids), 4096):
                    found = looked_up(part, codes[start : start + 4096])
                    which, record = np.nonzero(found <= state.distances[at : at + len(part), -1:])
                    state.keep(which + at, ids[start + record], ids[start + record], found[which, record])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), matrix(batch.column(1), own.m).astype(np.int16)))
                size += batch.num_rows
            if size >= RECORDS:
                look(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            look(*map(np.concatenate, zip(*held)))
        q, ids, _, distances = state.table(query_ids)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(distances)], names=["q_id", "id", "distance"])

    found = encoded.select("id", "codes").mapInArrow(run, "q_id bigint, id bigint, distance double")
    return best(found, k).select("q_id", "rank", "id", "distance")


def checked_queries(queries: DataFrame, dim: int, most: int = BROADCAST_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Query ids and vectors on the driver, once a count has shown that they are few enough."""
    count = queries.count()
    if count * dim * 8 > most:
        raise ValueError(f"{count} queries are too many to send to every executor; ask in parts")
    table = queries.select("q_id", "q").toArrow()
    return table["q_id"].to_numpy().astype(np.int64), matrix(table["q"], dim)
