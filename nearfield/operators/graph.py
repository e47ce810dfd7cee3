"""Navigable small-world graphs, one per shard, with exact or table distances.

A shard's graph is built in one task, in id order, so it is the same on any cluster; shards hold
some ``SHARD_ROWS`` vectors, whatever the table's size, which bounds a task's memory and time. A
built index is a table with one row a shard, its arrays packed as bytes (``SHARDS``). A search is a
scan of that table: each shard is asked where it is read, nothing but shortlists is shuffled,
and raw vectors are a column that is read only for reranking. ``nodes`` and ``edges`` are
explodes of it. Adding vectors inserts them into the shards they belong to; other
shards stay as they are.

Layers, degrees and searches: a node's top layer is ``floor(-ln(u) / ln(m))`` with ``u`` from a
hash of its id; it is linked on each of its layers to the ``m`` nearest of the ``ef_construction``
nodes that a beam finds there (``2m`` on layer 0); links go both ways, and a node over
its degree keeps its nearest and drops the others on both sides. What that cuts off (copies beyond
a degree, far groups) is linked again once all rows are in, so every node of layer 0 can be
reached. A beam as wide as its shard finds just what links reach from the entry, whatever the
query: it is taken in blocks of queries and nodes instead of a walk for each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.kernels import Best, Nearest, exact, matrix, prepared
from nearfield.operators.knn import best, check_k
from nearfield.operators.quantize import ProductQuantizer, checked_queries, looked_up

#: Vectors of a shard, and the fewest for which one more shard is worth a task of its own.
SHARD_ROWS, LEAST_ROWS = 1 << 14, 1 << 11
#: Rows of a shortlist that a task holds at a time, and nodes that queries are compared with at once.
SHORT_ROWS, NODES = 1 << 21, 1 << 12
#: A shard: node numbers follow the order of insertion; ``links`` holds each node's neighbours layer by layer, ``counts`` how many.
SHARDS = "shard int, size int, entry int, ids binary, levels binary, counts binary, links binary, payload binary, vecs binary"
#: Distances from the point a table was made for to some nodes.
Distances = Callable[[np.ndarray], np.ndarray]


def default_ef(size: int, m: int) -> int:
    """Beam width for ``size`` nodes if none is given."""
    return max(30, int(m * math.log2(max(size, 2))))


def level(key: Column, m: int, seed: int = 42) -> Column:
    """Top layer of a node: geometric, from a hash of its id."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.floor(-F.ln(u) / math.log(m)).cast("int")


@dataclass
class Shard:
    """One graph: levels and, per layer, each node's neighbours in ascending distance."""

    m: int
    levels: list[int]
    links: list[list[np.ndarray]]
    entry: int = -1

    def degree(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    def beam(self, near: Distances, starts: list[int], ef: int, layer: int) -> tuple[list[tuple[float, int]], int]:
        """The ``ef`` nearest nodes that a best-first walk finds, nearest first, and the nodes it looked at."""
        seen = set(starts)
        opened = sorted(zip(near(np.array(starts)).tolist(), starts))
        open_, kept = opened[:], [(-d, -n) for d, n in opened]
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        while open_:
            distance, node = heapq.heappop(open_)
            if len(kept) >= ef and distance > -kept[0][0]:
                break
            fresh = [n for n in self.links[node][layer].tolist() if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for d, n in zip(near(np.array(fresh)).tolist(), fresh):
                if len(kept) < ef:
                    heapq.heappush(kept, (-d, -n))
                elif (-d, -n) > kept[0]:
                    heapq.heapreplace(kept, (-d, -n))
                else:
                    continue
                heapq.heappush(open_, (d, n))
        return sorted((-d, -n) for d, n in kept), len(seen)

    def descend(self, near: Distances, to: int) -> tuple[int, int]:
        """The nearest node greedily reached from the entry on the layers above ``to``."""
        node, looked = self.entry, 0
        for layer in range(self.levels[self.entry], to, -1):
            found, n = self.beam(near, [node], 1, layer)
            node, looked = found[0][1], looked + n
        return node, looked

    def insert(self, node: int, near: Distances, between: Callable[[int], Distances], ef: int) -> None:
        """Link a new node; ``between`` gives a linked node's own distances."""
        top = self.levels[node]
        self.links.append([np.zeros(0, dtype=np.int64) for _ in range(top + 1)])
        if self.entry < 0:
            self.entry = node
            return
        at, _ = self.descend(near, top)
        starts = [at]
        for layer in range(min(top, self.levels[self.entry]), -1, -1):
            found, _ = self.beam(near, starts, ef, layer)
            self.links[node][layer] = np.array([n for _, n in found[: self.degree(layer)]], dtype=np.int64)
            for other in self.links[node][layer].tolist():
                self._link(other, node, layer, between)
            starts = [n for _, n in found]
        if top > self.levels[self.entry]:
            self.entry = node

    def _link(self, node: int, other: int, layer: int, between: Callable[[int], Distances]) -> None:
        linked = np.append(self.links[node][layer], other)
        if len(linked) > self.degree(layer):
            order = np.lexsort((linked, between(node)(linked)))
            for dropped in linked[order[self.degree(layer) :]].tolist():
                back = self.links[dropped][layer]
                self.links[dropped][layer] = back[back != node]
            linked = linked[order[: self.degree(layer)]]
        self.links[node][layer] = linked

    def parts(self) -> np.ndarray:
        """For each node the least node that layer 0 links it with, over any number of links."""
        counts = [len(layers[0]) for layers in self.links]
        label, node = np.arange(len(counts)), np.repeat(np.arange(len(counts)), counts)
        other = np.concatenate([layers[0] for layers in self.links]) if len(counts) else node
        while True:
            least = label.copy()
            np.minimum.at(least, node, label[other])
            np.minimum.at(least, other, label[node])
            least = least[least]
            if (least == label).all():
                return label
            label = least

    def connect(self, between: Callable[[int], Distances]) -> None:
        """Link each part of layer 0 that the entry's does not reach to the nearest node of that one with a free place."""
        label = self.parts()
        if not len(label) or (label == label[0]).all():
            return
        order = np.argsort(label, kind="stable")
        every = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
        inside = label == label[self.entry]
        free = np.array([len(layers[0]) < self.degree(0) for layers in self.links])
        for part in every:
            if inside[part[0]]:
                continue
            ends = []
            for side in (part, None):
                if side is None:
                    side = np.flatnonzero(inside)
                if not free[side].any():
                    dropped = self._opened(side.tolist())
                    free[dropped] = True
                side = side[free[side]]
                ends.append(int(side[0] if not ends else side[np.argmin(between(ends[0])(side))]))
            for node, other in (ends, ends[::-1]):
                self.links[node][0] = np.append(self.links[node][0], other)
                free[node] = len(self.links[node][0]) < self.degree(0)
            inside[part] = True

    def _opened(self, nodes: list[int]) -> list[int]:
        """The ends of a link on a circle, which is dropped: a part whose nodes are all full has one, and stays whole without it."""
        above = {n: n for n in nodes}

        def root(node: int) -> int:
            while above[node] != node:
                above[node] = node = above[above[node]]
            return node

        for node in nodes:
            for other in self.links[node][0].tolist():
                if other > node:
                    a, b = root(node), root(other)
                    if a == b:
                        for one, two in ((node, other), (other, node)):
                            self.links[one][0] = self.links[one][0][self.links[one][0] != two]
                        return [node, other]
                    above[a] = b
        raise ValueError("no link on a circle: the links do not go both ways")

    def search(self, near: Distances, count: int, ef: int) -> tuple[list[tuple[float, int]], int]:
        node, looked = self.descend(near, 0)
        found, n = self.beam(near, [node], ef, 0)
        return found[:count], looked + n

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Levels, counts and links as little-endian 32-bit numbers."""
        layers = [layer for node in self.links for layer in node]
        flat = np.concatenate(layers) if layers else np.zeros(0)
        return tuple(np.asarray(x, dtype="<i4").tobytes() for x in (self.levels, list(map(len, layers)), flat))

    @staticmethod
    def unpacked(m: int, entry: int, levels: bytes, counts: bytes, links: bytes) -> Shard:
        own, ends = np.frombuffer(levels, "<i4").tolist(), np.cumsum(np.frombuffer(counts, "<i4"))
        layers = iter(np.split(np.frombuffer(links, "<i4").astype(np.int64), ends[:-1]) if len(ends) else [])
        return Shard(m, own, [[next(layers) for _ in range(level + 1)] for level in own], entry)


@dataclass
class GraphIndex:
    """Sharded graph over vectors (cosine) or, with a quantiser, over codes (squared distance).

    Without a number of ``shards`` the first build takes as many as the table's size asks for.
    """

    dim: int
    m: int = 16
    ef_construction: int = 200
    seed: int = 42
    shards: int | None = None
    pq: ProductQuantizer | None = None
    store_full_vectors: bool = True

    def __post_init__(self) -> None:
        if min(self.dim, self.m, self.ef_construction, self.shards or 1) <= 0 or self.m < 2:
            raise ValueError("dim, ef_construction and shards must be positive and m at least 2")
        if self.pq is not None and self.pq.dim != self.dim:
            raise ValueError("the quantiser has another dimension")

    def build(self, vectors: DataFrame) -> DataFrame:
        """The shards of ``vectors`` [id, vec]; in each the ids decide the order of insertion."""
        count, tasks = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
        if self.shards is None:
            self.shards = max(1, -(-count // SHARD_ROWS), min(tasks, count // LEAST_ROWS))
        index = self
        built = self._dealt(vectors).groupBy("shard").applyInArrow(lambda rows: index._inserted(None, rows), SHARDS)
        built._rows = count  # a search that asks this very table knows its size
        return built

    def extend(self, shards: DataFrame, vectors: DataFrame) -> DataFrame:
        """Shards after inserting more rows: those without new rows stay as they are."""
        index = self
        both = shards.groupBy("shard").cogroup(self._dealt(vectors).groupBy("shard"))
        return both.applyInArrow(lambda old, rows: index._inserted(old, rows) if rows.num_rows else old, SHARDS)

    def _dealt(self, vectors: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int")
        return vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<float>").alias("vec"), level(F.col("id"), self.m, self.seed).alias("level"), shard.alias("shard"))

    def _inserted(self, old: pa.Table | None, rows: pa.Table) -> pa.Table:
        """One shard's row after inserting ``rows`` into ``old``."""
        rows = rows.sort_by("id")
        raw = matrix(rows["vec"], self.dim)
        ids, levels = rows["id"].to_numpy().astype("<i8"), rows["level"].to_numpy().tolist()
        payload = prepared(raw, "cosine") if self.pq is None else self.pq.codes_of(raw).astype(np.float64)
        graph, first = Shard(self.m, levels, []), 0
        if old is not None and old.num_rows:
            was = {c: old[c][0].as_py() for c in old.column_names}
            graph, first = Shard.unpacked(self.m, was["entry"], was["levels"], was["counts"], was["links"]), was["size"]
            graph.levels = graph.levels + levels
            payload = np.concatenate([self._payload(was["payload"]), payload])
            ids = np.concatenate([np.frombuffer(was["ids"], "<i8"), ids])
            if was["vecs"] is None and self.pq is not None:
                raise ValueError("adding to a graph over codes needs stored vectors")
            old_raw = payload[:first] if was["vecs"] is None else np.frombuffer(was["vecs"], "<f4").reshape(first, -1).astype(np.float64)
            raw = np.concatenate([old_raw, raw])
        tables = None if self.pq is None else self.pq.code_tables()
        between = lambda n: self.distances(payload, raw[n], payload[n], tables)
        for node in range(first, len(ids)):
            graph.insert(node, self.distances(payload, raw[node]), between, self.ef_construction)
        graph.connect(between)
        levels, counts, links = graph.packed()
        values = [rows["shard"][0].as_py(), len(ids), graph.entry, ids.tobytes(), levels, counts, links, payload.astype("<f8" if self.pq is None else np.uint8).tobytes(), raw.astype("<f4").tobytes() if self.store_full_vectors else None]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in SHARDS.split(", ")])

    def _payload(self, data: bytes) -> np.ndarray:
        """Unit vectors or codes, a row for each node."""
        return np.frombuffer(data, "<f8").reshape(-1, self.dim) if self.pq is None else np.frombuffer(data, np.uint8).reshape(-1, self.pq.m).astype(np.float64)

    def distances(self, payload: np.ndarray, point: np.ndarray, own: np.ndarray | None = None, tables: np.ndarray | None = None) -> Distances:
        """Distances from a vector to nodes; from a node, if its ``own`` unit vector or codes are given (and ``tables`` between codes)."""
        if self.pq is None:
            unit = prepared(point[None], "cosine")[0] if own is None else own
            return lambda nodes: 1.0 - payload[nodes] @ unit
        subspaces = np.arange(self.pq.m)
        table = self.pq.tables(point[None])[0] if own is None else (self.pq.code_tables() if tables is None else tables)[subspaces, own.astype(np.int64)]
        return lambda nodes: table[subspaces, payload[nodes].astype(np.int64)].sum(1)

    def search(self, shards: DataFrame, queries: DataFrame, k: int = 10, ef: int | None = None, rerank: int = 0) -> DataFrame:
        """[q_id, rank, id, distance] of the nearest that the shards' walks find."""
        return self.visited(shards, queries, k, ef, rerank).select("q_id", "rank", "id", "distance")

    def visited(self, shards: DataFrame, queries: DataFrame, k: int = 10, ef: int | None = None, rerank: int = 0) -> DataFrame:
        """The same with the nodes that all shards looked at for the query, and the beam width."""
        check_k(k, rerank=rerank)
        if ef is not None and ef <= 0:
            raise ValueError("ef must be positive")
        if rerank and (self.pq is None or not self.store_full_vectors):
            raise ValueError("reranking needs codes and stored vectors")
        query_ids, rows = checked_queries(queries, self.dim)
        sent, index, short = queries.sparkSession.sparkContext.broadcast((query_ids, rows)), self, max(k, rerank)
        columns = ["size", "entry", "ids", "levels", "counts", "links", "payload", *["vecs"] * bool(rerank)]
        # a shortlist that can hold the whole table cuts nothing: exact distances decide at once
        total = getattr(shards, "_rows", None)
        whole = bool(rerank) and total is not None and short >= total

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, rows = sent.value
            for batch in batches:
                for at in range(batch.num_rows):
                    yield from index._asked({c: batch.column(i)[at].as_py() for i, c in enumerate(columns)}, query_ids, rows, short, ef, k if whole else None)

        found = shards.select(*columns).mapInArrow(run, "q_id bigint, id bigint, distance double, exact double, looked bigint, ef int")
        # a shard tells the nodes it looked at once for each query, in the row of its nearest node
        each = Window.partitionBy("q_id")
        found = found.withColumns({"nodes_visited": F.sum("looked").over(each), "ef": F.max("ef").over(each)}).drop("looked")
        top = best(found, k if whole else short)
        if rerank:
            top = best(top.withColumn("distance", F.col("exact")), k)
        return top.filter(F.col("rank") <= k).select("q_id", "rank", "id", "distance", "nodes_visited", "ef")

    def _asked(self, shard: dict, query_ids: np.ndarray, rows: np.ndarray, short: int, ef: int | None, exact_k: int | None) -> Iterator[pa.RecordBatch]:
        """The rows that one shard finds, some queries at a time; with ``exact_k`` that many by exact distance, of all nodes that links reach."""
        payload, ids, size = self._payload(shard["payload"]), np.frombuffer(shard["ids"], "<i8"), shard["size"]
        graph = Shard.unpacked(self.m, shard["entry"], shard["levels"], shard["counts"], shard["links"])
        width = min(size, max(ef or default_ef(size, self.m), short))
        raw = np.frombuffer(shard["vecs"], "<f4").reshape(size, -1) if "vecs" in shard else None
        if width == size and size:
            part = graph.parts()
            reached = np.flatnonzero(part == part[graph.entry])
            found = self._full(payload, raw, ids, reached, rows, min(short, size), exact_k)
        else:
            found = self._walked(graph, payload, rows, min(short, size), width)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
        for which, at, near, looked in found:
            real = np.concatenate([exact(rows[which[i : i + NODES]], raw[at[i : i + NODES]].astype(np.float64), "l2") for i in range(0, len(at), NODES)] or [near]) if raw is not None else np.zeros(len(at))
            first = np.concatenate([[True], which[1:] != which[:-1]])[: len(which)]
            columns = (query_ids[which], ids[at], near, real, np.where(first, looked, 0), np.full(len(at), width))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["q_id", "id", "distance", "exact", "looked", "ef"])

    def _walked(self, graph: Shard, payload: np.ndarray, rows: np.ndarray, short: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(number of the query, node, distance, nodes looked at) of what a walk for each query finds, nearest first."""
        step = max(1, SHORT_ROWS // max(1, short))
        for start in range(0, len(rows), step):
            parts = []
            for q in range(start, min(len(rows), start + step)):
                found, looked = graph.search(self.distances(payload, rows[q]), short, width)
                at, near = np.array([n for _, n in found], dtype=np.int64), np.array([d for d, _ in found])
                if self.pq is None:  # products only led the walk
                    near = exact(prepared(np.tile(rows[q], (len(at), 1)), "cosine"), payload[at], "cosine")
                parts.append((np.full(len(at), q), at, near, np.full(len(at), looked)))
            yield tuple(map(np.concatenate, zip(*parts)))

    def _full(self, payload: np.ndarray, raw: np.ndarray | None, ids: np.ndarray, reached: np.ndarray, rows: np.ndarray, short: int, exact_k: int | None) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for a beam as wide as the shard, which finds every node that is ``reached``."""
        size = min(len(reached), short if exact_k is None else exact_k)
        step = max(1, min(1024, SHORT_ROWS // size))
        for start in range(0, len(rows), step):
            asked = rows[start : start + step]
            if exact_k is not None or self.pq is None:
                state = Nearest(asked, size, "l2" if exact_k is not None else "cosine", unit=True)
            else:
                state, tables = Best(len(asked), size), self.pq.tables(asked)
            for at in range(0, len(reached), NODES):
                nodes = reached[at : at + NODES]
                if isinstance(state, Nearest):
                    state.add(ids[nodes], raw[nodes].astype(np.float64) if exact_k is not None else payload[nodes], payload=nodes)
                    continue
                codes = payload[nodes].astype(np.int64)
                for first in range(0, len(asked), 256):
                    near = looked_up(tables[first : first + 256], codes)
                    which, node = np.nonzero(near <= state.distances[first : first + 256, -1:])
                    state.keep(which + first, ids[nodes[node]], nodes[node], near[which, node])
            which, _, at, near = state.table(np.arange(start, start + len(asked)))
            yield which, at, near, np.full(len(at), len(reached))


def nodes(shards: DataFrame, m: int) -> DataFrame:
    """[shard, node, id, level, entry, neighbours (an array for each layer)]."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard, entry, ids, levels, counts, links = (batch.column(i)[at].as_py() for i in range(6))
                graph = Shard.unpacked(m, entry, levels, counts, links)
                every = np.arange(len(graph.levels))
                columns = [pa.array(np.full(len(every), shard), pa.int32()), pa.array(every, pa.int32()), pa.array(np.frombuffer(ids, "<i8")), pa.array(graph.levels, pa.int32()), pa.array(every == entry)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(graph.links, pa.list_(pa.list_(pa.int32())))], names=["shard", "node", "id", "level", "entry", "neighbours"])

    return shards.select("shard", "entry", "ids", "levels", "counts", "links").mapInArrow(run, "shard int, node int, id bigint, level int, entry boolean, neighbours array<array<int>>")


def edges(shards: DataFrame, m: int = 16) -> DataFrame:
    """[shard, layer, node, neighbour]."""
    layers = nodes(shards, m).select("shard", "node", F.posexplode("neighbours").alias("layer", "linked"))
    return layers.select("shard", "layer", "node", F.explode("linked").alias("neighbour"))


def one_way(shards: DataFrame) -> DataFrame:
    """Edges without their reverse: none in a sound graph."""
    found = edges(shards)
    back = found.select("shard", "layer", F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))
    return found.join(back, ["shard", "layer", "node", "neighbour"], "left_anti")


def over_degree(shards: DataFrame, m: int) -> DataFrame:
    """Nodes with more neighbours on a layer than allowed: none in a sound graph."""
    counts = nodes(shards, m).select("shard", "node", F.posexplode("neighbours").alias("layer", "linked")).withColumn("degree", F.size("linked"))
    return counts.filter(F.col("degree") > F.when(F.col("layer") == 0, 2 * m).otherwise(m)).select("shard", "layer", "node", "degree")


def graph_bytes(shards: DataFrame) -> DataFrame:
    """[nodes, edges, bytes] of the graph as it is stored: levels, counts and links."""
    size = lambda c: F.octet_length(c).cast("long")
    return shards.agg(F.sum("size").cast("long").alias("nodes"), F.sum((size("links") / 4).cast("long")).alias("edges"), F.sum(size("links") + size("levels") + size("counts")).alias("bytes"))
