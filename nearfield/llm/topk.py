"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. The index holds vectors in blocks of ``BLOCK``; a block has, for each
component, posting lists of (vector, value) by impact: a value's impact is its magnitude, quantised to
its bit length. A search takes a block's segments of equal impact, the largest first, and adds
their postings to the accumulators. After each segment a vector's score lies within
``|query| * |what is left of the vector|`` of its accumulator. That proves, query by query, which vectors can still
be among the best k of all seen; a query stops in this block as soon as rescoring them exactly takes
fewer steps than the postings that are left. Without a proof all its segments are added, which makes its scores exact.

Plan. The index is a table with one row a block, made where the vectors are read. Queries are sent to
every executor in sets of at most ``QUERY_BYTES``, counted first; each task keeps every query's best k of
the blocks it reads, and a window with a partial limit merges them. Vectors are never shuffled; with
more than one set the index is written once and read for each.

Defined cases: a vector that is null or has a null or non-finite component takes no part, as
query or candidate, nor does a row whose key is null; vectors of different lengths are compared as if
padded by zeros; a query does not meet rows with its own id; repeated rows are each a candidate and each a
query (the ranks of queries with one id repeat); ties go to the smaller id; any finite components give
exact ranks (beyond 2**53 by whole numbers of any size; a score beyond 64 bits is told as the nearest
64-bit one); an empty table gives an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.shared import settled

#: Vectors of a block, and queries that are scored together.
BLOCK, TOGETHER = 1024, 256
#: Postings that take as long as one component of a vector that is rescored, and the share of vectors from which lists are added as a product.
RESCORING, DENSE = 8, 1 / 32
#: Bytes of the queries (as doubles) that are sent at a time.
QUERY_BYTES = 64 << 20
#: A row of the index; numbers are little-endian.
INDEX = "size int, width int, ids binary, levels binary, components binary, counts binary, vectors binary, values binary"
FOUND = "query_id bigint, query_row bigint, vec_id bigint, score bigint, beyond binary"
LARGEST = 2**63 - 1


@dataclass
class Block:
    """Posting lists of some vectors: segment s has component ``components[s]``, impact ``levels[s]`` and the next ``counts[s]`` postings."""

    ids: np.ndarray
    width: int
    levels: np.ndarray
    components: np.ndarray
    counts: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, rows: np.ndarray) -> Block:
        """The lists of a matrix of integers (as doubles)."""
        vector, component = np.nonzero(rows)
        value = rows[vector, component]
        level = np.frexp(value)[1]  # the bit length of an integer
        order = np.lexsort((vector, component, -level))
        vector, component, value, level = vector[order], component[order], value[order], level[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(level) != 0) | (np.diff(component) != 0)])) if len(level) else np.zeros(0, np.int64)
        return Block(ids, rows.shape[1], level[first].astype("<i4"), component[first].astype("<i4"), np.diff(np.append(first, len(level))).astype("<i4"), vector.astype("<i4"), value.astype("<f8"))

    def row(self) -> list:
        return [len(self.ids), self.width, *(x.tobytes() for x in (self.ids.astype("<i8"), self.levels, self.components, self.counts, self.vectors, self.values))]

    @staticmethod
    def read(size: int, width: int, *parts: bytes) -> Block:
        ids, levels, components, counts, vectors, values = (np.frombuffer(p, kind) for p, kind in zip(parts, ("<i8", "<i4", "<i4", "<i4", "<i4", "<f8")))
        return Block(ids, width, levels, components, counts, vectors, values)

    def dense(self) -> np.ndarray:
        rows = np.zeros((len(self.ids), self.width))
        rows[self.vectors, np.repeat(self.components, self.counts)] = self.values
        return rows


class Best:
    """The k best (score, id) so far of each query; ``exact`` whole numbers of any size once a score asks for them."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.scores = np.full((count, k), -np.inf)
        self.ids = np.full((count, k), LARGEST)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some queries' vectors."""
        if scores.dtype == object and self.scores.dtype != object:
            whole = np.empty(self.scores.shape, dtype=object)
            whole[:] = [[int(s) if np.isfinite(s) else s for s in row] for row in self.scores.tolist()]
            self.scores = whole
        last = self.scores[query, -1]
        keep = ((scores > last) | ((scores == last) & (ids < self.ids[query, -1]))).astype(bool)
        query, ids, scores = query[keep], ids[keep], scores[keep]
        if not len(query):
            return
        changed = np.unique(query)
        query = np.concatenate([query, np.repeat(changed, self.k)])
        ids = np.concatenate([ids, self.ids[changed].ravel()])
        scores = np.concatenate([scores, self.scores[changed].ravel()])
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -scores[i], ids[i]))) if scores.dtype == object else np.lexsort((ids, -scores, query))
        take = order[(np.searchsorted(query[order], changed)[:, None] + np.arange(self.k)).ravel()]
        self.scores[changed] = scores[take].reshape(-1, self.k)
        self.ids[changed] = ids[take].reshape(-1, self.k)


def search_block(block: Block, queries: np.ndarray, query_ids: np.ndarray, best: Best, at: int) -> int:
    """Score a block for queries that are ``best``'s from number ``at``; the number of segments that queries didn't need."""
    if not len(block.ids) or not len(queries):
        return 0
    rows, width = block.dense(), max(block.width, queries.shape[1])
    rows, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, queries))
    bound = width * np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)
    if not bound < 2**53:
        _search_wide(block, rows, queries, query_ids, best, at)
        return 0
    kind = np.float32 if bound < 2**24 else np.float64  # sums of integers are exact in either
    active = np.arange(len(queries))
    asked = np.ascontiguousarray(queries.T, dtype=kind)
    lengths = np.sqrt((queries * queries).sum(1))
    scores = np.zeros((len(rows), len(queries)), dtype=kind)
    scores[block.ids[:, None] == query_ids[None, :]] = -np.inf
    left = (rows * rows).sum(1)
    ends = np.cumsum(block.counts)
    bounds = [0, *(np.flatnonzero(np.diff(block.levels)) + 1).tolist(), len(block.counts)]  # of the impacts' segments
    skipped = 0
    for first, stop in zip(bounds, bounds[1:]):
        start, end = int(ends[first] - block.counts[first]), int(ends[stop - 1])
        which, values, counts = block.vectors[start:end], block.values[start:end], block.counts[first:stop]
        components = block.components[first:stop]
        if end - start >= DENSE * len(rows) * len(components):  # lists so full are added as one product
            tile = np.zeros((len(rows), len(components)), dtype=kind)
            tile[which, np.repeat(np.arange(len(components)), counts)] = values
            scores += tile @ asked[components]
        else:
            for component, lo, hi in zip(components.tolist(), (ends[first:stop] - counts).tolist(), ends[first:stop].tolist()):
                scores[block.vectors[lo:hi]] += block.values[lo:hi, None].astype(kind) * asked[component]
        left -= np.bincount(which, values * values, len(rows))
        if stop == len(block.counts):
            break
        bar = best.scores[at + active, -1].astype(np.float64)
        rest = np.sqrt(np.maximum(left, 0)) * (1 + 1e-9)
        possible = scores + rest[:, None] * lengths[active] + 1e-3 >= bar
        proven = np.isfinite(bar) & (possible.sum(0) * width * RESCORING <= len(block.values) - end)
        if proven.any():
            vector, query = np.nonzero(possible[:, proven] & np.isfinite(scores[:, proven]))
            query = active[proven][query]
            best.add(query + at, block.ids[vector], np.einsum("ij,ij->i", queries[query], rows[vector]))
            skipped += int(proven.sum()) * (len(block.counts) - stop)
            active, scores, asked = active[~proven], scores[:, ~proven], np.ascontiguousarray(asked[:, ~proven])
            if not len(active):
                return skipped
    bar = best.scores[at + active, -1].astype(np.float64)
    if len(rows) > best.k:  # what is not among the block's own best k can't be among all
        bar = np.maximum(bar, np.partition(scores, -best.k, axis=0)[-best.k])
    vector, query = np.nonzero((scores >= bar) & np.isfinite(scores))
    best.add(active[query] + at, block.ids[vector], scores[vector, query].astype(np.float64))
    return skipped


def _search_wide(block: Block, rows: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best, at: int) -> None:
    """The same where doubles are not exact: they only tell which vectors are possible, whole numbers rescore those."""
    whole = [[int(x) for x in row] for row in rows.tolist()]
    top = max(np.abs(rows).max(), 1.0)
    small = rows / top  # products can't overflow
    for i, query in enumerate(queries):
        scale = max(np.abs(query).max(), 1.0)
        near = small @ (query / scale)
        margin = 1e-12 * (np.abs(small) @ np.abs(query / scale)) + 1e-300
        own = block.ids == query_ids[i]
        low = np.where(own, -np.inf, near - margin)
        possible = ~own
        if len(low) > best.k:
            possible &= near + margin >= np.partition(low, -best.k)[-best.k]
        found = np.flatnonzero(possible)
        mine = [int(x) for x in query.tolist()]
        exact = np.empty(len(found), dtype=object)
        exact[:] = [sum(a * b for a, b in zip(mine, whole[j])) for j in found.tolist()]
        best.add(np.full(len(found), at + i), block.ids[found], exact)


def quantised(column: pa.ListArray, scale: int) -> np.ndarray:
    """Rows of integers as doubles, padded by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


def _beyond(score) -> bytes | None:
    """Bytes that sort as scores that 64 bits can't tell apart do."""
    if -LARGEST < score < LARGEST:
        return None
    return (int(score) + (1 << 2400)).to_bytes(304, "big")


def index(rows: DataFrame, scale: int) -> DataFrame:
    """The blocks of rows [id, v]."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            row = Block.of(table["id"].to_numpy(), quantised(table["v"].combine_chunks(), scale)).row()
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == BLOCK:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    return rows.select("id", "v").mapInArrow(run, INDEX)


def search(blocks: DataFrame, queries: tuple[np.ndarray, np.ndarray], first_row: int, k: int) -> DataFrame:
    """Every task's best k for each query (ids, matrix)."""
    sent = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, rows = sent.value
        best = Best(len(rows), k)
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block.read(*(batch.column(i)[at].as_py() for i in range(batch.num_columns)))
                for start in range(0, len(rows), TOGETHER):
                    search_block(block, rows[start : start + TOGETHER], query_ids[start : start + TOGETHER], best, start)
        for start in range(0, len(rows), 512):
            ids, scores = best.ids[start : start + 512], best.scores[start : start + 512]
            which, place = np.nonzero(scores.astype(np.float64) > -np.inf) if scores.dtype != object else np.nonzero(np.array([[s != -np.inf for s in row] for row in scores]))
            told = [int(s) for s in scores[which, place]]
            columns = [query_ids[which + start], which + start + first_row, ids[which, place], [max(-LARGEST, min(LARGEST, s)) for s in told]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(list(map(_beyond, told)), pa.binary())], names=[c.split()[0] for c in FOUND.split(", ")])

    return blocks.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """For each row that ``is_query`` holds for: query_id, rank, vec_id, score of its best k rows."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    queries = rows.filter("asks").select("id", "v")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size.n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sets = -(-size.n * max(size.width, 1) * 8 // QUERY_BYTES)
    blocks = index(rows, scale)
    if sets > 1:
        blocks = settled(blocks)
        queries = settled(queries.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(sets))))
    parts = []
    for part in range(sets):
        own = (queries.filter(F.col("part") == part) if sets > 1 else queries).select("id", "v").toArrow()  # ``QUERY_BYTES``, about
        parts.append(search(blocks, (own["id"].to_numpy(), quantised(own["v"].combine_chunks(), scale)), part << 40, k))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
