"""NumPy kernels on Arrow batches: matrix products find candidates, exact sums decide.

Distances are sums in double from the first component to the last, so they are bit-equal to
the Column expressions and to SQL; ties then fall to the smaller id everywhere. Products only
narrow the candidates, with a margin far above their rounding error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from nearfield.functions.vectors import EPSILON

METRICS = ("cosine", "l2", "dot")
#: Pairs of a query and a vector that get their exact distance at a time.
PAIRS = 1 << 16


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles; all need the same size (``dim``, if given)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or (len(sizes) and (sizes != (dim or sizes[0])).any()):
        raise ValueError(f"every vector needs {dim or 'the same number of'} components")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, dim or 0))


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix's rows as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel(), kind))


def running_sum(terms) -> np.ndarray:
    """Sum from the first term to the last."""
    total = None
    for term in terms:
        total = 0.0 + term if total is None else total + term
    return total


def prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric not in METRICS:
        raise ValueError("metric must be 'cosine', 'l2' or 'dot'")
    if metric != "cosine" or not vectors.size:
        return vectors
    norms = np.sqrt(running_sum(vectors[:, i] * vectors[:, i] for i in range(vectors.shape[1])))
    return vectors / (norms + EPSILON)[:, None]


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of prepared vectors, row by row."""
    if metric == "l2":
        return running_sum((a[:, i] - b[:, i]) * (a[:, i] - b[:, i]) for i in range(a.shape[1]))
    product = running_sum(a[:, i] * b[:, i] for i in range(a.shape[1]))
    return 1.0 - product if metric == "cosine" else -product


def rough(queries: np.ndarray, vectors: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances by a matrix product, and what they may be off by."""
    product = queries @ vectors.T
    if metric != "l2":
        return -product, 1e-12 * (1 + np.abs(product).max(initial=0)) + 1e-12 * np.sqrt((queries**2).sum(1).max(initial=0) * (vectors**2).sum(1).max(initial=0))
    lengths, own = (vectors * vectors).sum(1), (queries * queries).sum(1)
    return lengths[None, :] - 2.0 * product + own[:, None], 1e-11 * (lengths.max(initial=0) + own.max(initial=0)) + 1e-300


def firsts(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """False for a vector if ``k`` equal ones have smaller ids (or the same, and stand before it): it is never among the k nearest."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    place = np.arange(len(ids)) - np.searchsorted(same[order], same[order])
    out = np.zeros(len(ids), dtype=bool)
    out[order[place < k]] = True
    return out


class Best:
    """The k least distances of each query with their ids and a payload; equal distances go to the smaller id, then to the row seen first."""

    def __init__(self, count: int, k: int, payload: type = np.int64):
        self.k = k
        self.distances = np.full((count, k), np.inf)
        self.ids = np.full((count, k), np.iinfo(np.int64).max)
        self.payload = np.zeros((count, k), dtype=payload)

    def keep(self, query: np.ndarray, ids: np.ndarray, payload: np.ndarray, found: np.ndarray) -> None:
        """Merge rows (query number, id, payload, distance)."""
        if not len(query):
            return
        changed = np.unique(query)
        query = np.concatenate([np.repeat(changed, self.k), query])
        ids = np.concatenate([self.ids[changed].ravel(), ids])
        payload = np.concatenate([self.payload[changed].ravel(), payload])
        found = np.concatenate([self.distances[changed].ravel(), found])
        order = np.lexsort((ids, found, query))
        first = np.searchsorted(query[order], changed)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        for own, values in ((self.distances, found), (self.ids, ids), (self.payload, payload)):
            own[changed] = values[take].reshape(-1, self.k)

    def table(self, query_ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query id, id, payload, distance of all that was found."""
        found = np.isfinite(self.distances)
        which = np.nonzero(found)[0]
        return query_ids[which], self.ids[found], self.payload[found], self.distances[found]


class Nearest(Best):
    """The k nearest vectors seen so far of each query; ``unit``: the vectors come prepared."""

    def __init__(self, queries: np.ndarray, k: int, metric: str, unit: bool = False):
        super().__init__(len(queries), k)
        self.queries, self.metric, self.unit = prepared(queries, metric), metric, unit

    def add(self, ids: np.ndarray, vectors: np.ndarray, block: int = 1 << 21, payload: np.ndarray | None = None, who: np.ndarray | None = None) -> None:
        """``payload`` is kept with each vector, else its id; ``who`` are the numbers of the queries that meet these vectors, else all do."""
        vectors, payload = vectors if self.unit else prepared(vectors, self.metric), ids if payload is None else payload
        step = max(1, block // max(1, len(ids)))
        every, use = np.arange(len(self.queries)) if who is None else who, None
        for start in range(0, len(every), step):
            numbers = every[start : start + step]
            own = self.queries[numbers]
            near, error = rough(own, vectors, self.metric)
            if len(ids) > self.k:
                bar = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
            else:
                bar = np.full(len(own), np.inf)
            worst = self.distances[numbers, -1] - (1.0 if self.metric == "cosine" else 0.0)
            which, at = np.nonzero(near <= np.minimum(bar, worst)[:, None] + 2 * error)
            if len(which) > PAIRS:  # copies of a vector are all as near: the k of least id are enough
                use = firsts(ids, vectors, self.k) if use is None else use
                which, at = which[use[at]], at[use[at]]
            for first in range(0, len(which), PAIRS):
                w, a = which[first : first + PAIRS], at[first : first + PAIRS]
                self.keep(numbers[w], ids[a], payload[a], exact(own[w], vectors[a], self.metric))


def nearest(vectors: np.ndarray, centroids: np.ndarray, count: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest centroids of each vector by squared distance, lowest number first among equals."""
    found = Nearest(vectors, min(count, len(centroids)), "l2")
    found.add(np.arange(len(centroids)), centroids)
    return found.ids, found.distances
