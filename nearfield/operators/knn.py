"""Exact nearest neighbours of a table of queries in a table of vectors.

``base`` has an id and a vector, ``queries`` a query id and a vector; the result is
``[q_id, rank, id, distance]``, ranks from 1, equal distances by id. Ids may repeat.

Plans. *Arrow* (the default): queries under ``BROADCAST_BYTES`` (counted first) are sent to all
executors, each task keeps the k nearest of the batches it streams, and a window with a
partial limit merges them, so the base is neither shuffled nor sorted. More queries
are dealt into sets and the base into shares; each pair of them is one task.
*Columns*: a broadcast nested-loop join and array functions, all in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators.kernels import METRICS, Nearest, matrix
from nearfield.sources.work import work_dir

#: Most bytes of queries (as doubles) that are sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Queries of a set and vectors of a share beyond that.
SET, SHARE = 8192, 1 << 21
RESULT = "q_id bigint, id bigint, distance double"


def check_k(k: int, **others: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    for name, value in others.items():
        if value < 0:
            raise ValueError(f"{name} must not be negative")


def best(found: DataFrame, k: int, by: str = "distance", descending: bool = False) -> DataFrame:
    """The first k rows of each query; Spark limits each partition before it shuffles."""
    order = F.col(by).desc() if descending else F.col(by)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(order, "id"))).filter(F.col("rank") <= k)


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", kernel: str = "arrow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest rows of ``base`` [id, vec] for each row of ``queries`` [q_id, q]."""
    check_k(k)
    if metric not in METRICS:
        raise ValueError("metric must be 'cosine', 'l2' or 'dot'")
    base, queries = base.select("id", "vec"), queries.select("q_id", "q")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("q")).alias("least"), F.max(F.size("q")).alias("dim")).first()
    if not size.n:
        return base.sparkSession.createDataFrame([], "q_id bigint, rank int, id bigint, distance double")
    if size.least != size.dim:
        raise ValueError("queries differ in their number of components")
    small = size.n * size.dim * 8 <= broadcast_bytes
    if kernel == "columns":
        if not small:
            raise ValueError("too many queries for a broadcast join; use the arrow kernel")
        scaled, far = (V.normalize, V.unit_cosine_distance) if metric == "cosine" else (lambda v: v.cast("array<double>"), lambda a, b: V.distance(a, b, metric))
        given = base.select("id", scaled(V.has_dimension(F.col("vec"), size.dim)).alias("vec"))
        met = given.crossJoin(F.broadcast(queries.select("q_id", scaled(F.col("q")).alias("q"))))  # scaled once a row, not once a pair
        found = met.select("q_id", "id", far(F.col("vec"), F.col("q")).alias("distance"))
    elif small:
        table = queries.toArrow()
        ids, rows = table["q_id"].to_numpy().astype(np.int64), matrix(table["q"], size.dim)
        sent = base.sparkSession.sparkContext.broadcast((ids, rows))
        found = base.mapInArrow(lambda batches: _stream(batches, sent.value, k, metric), RESULT)
    else:
        found = _grid(base, queries, size.n, size.dim, k, metric)
    return best(found, k).select("q_id", "rank", "id", "distance")


def _emit(state: Nearest, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    q, ids, _, distances = state.table(query_ids)
    for start in range(0, len(q), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(q[part]), pa.array(ids[part]), pa.array(distances[part])], names=["q_id", "id", "distance"])


def _stream(batches: Iterable[pa.RecordBatch], sent: tuple[np.ndarray, np.ndarray], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    ids, queries = sent
    state = Nearest(queries, k, metric)
    for batch in batches:
        if batch.num_rows:
            state.add(batch.column(0).to_numpy().astype(np.int64), matrix(batch.column(1), queries.shape[1]))
    yield from _emit(state, ids)


def _grid(base: DataFrame, queries: DataFrame, n: int, dim: int, k: int, metric: str) -> DataFrame:
    """Each cell has a set of queries (kind 0), then a share of the base (kind 1)."""
    sets = -(-n // SET)
    shares = max(1, -(-base.count() // SHARE))
    asked = queries.select(F.pmod(F.xxhash64("q_id"), F.lit(sets)).alias("set"), F.lit(0).alias("kind"), F.col("q_id").alias("id"), F.col("q").alias("vec"))
    each = lambda count, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), cell)).alias("cell")
    asked = asked.select(each(shares, lambda share: F.col("set") * shares + share), "kind", "id", "vec")
    given = base.withColumn("share", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shares)))
    given = given.select(each(sets, lambda own: own * shares + F.col("share")), F.lit(1).alias("kind"), "id", "vec")
    dealt = asked.unionByName(given).repartition(sets * shares, "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, state, ids = None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield from _emit(state, ids)

        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                rows = (part.column(2).to_numpy().astype(np.int64), matrix(part.column(3), dim))
                if cells[start] != cell:
                    yield from done()
                    cell, asked, state = cells[start], [], None
                if kinds[start] == 0:
                    asked.append(rows)
                elif asked:
                    if state is None:
                        ids = np.concatenate([a[0] for a in asked])
                        state = Nearest(np.concatenate([a[1] for a in asked]), k, metric)
                    state.add(*rows)
        yield from done()

    return dealt.mapInArrow(run, RESULT)


def with_position_ids(vectors: DataFrame, order: str | list[str], offset: int = 0, to: str = "id") -> DataFrame:
    """Numbers by position in ``order``, from ``offset``: each partition's follow the previous one's.

    The rows are range-sorted and written once, with their partition and place in it: sizes and
    numbers come from the same files, so neither another sampling of the ranges nor another
    coalescing of partitions can part them. Only the partitions' starts pass through the driver.
    """
    order = [order] if isinstance(order, str) else order
    spark, path = vectors.sparkSession, work_dir(vectors.sparkSession, "positions")
    dealt = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    dealt.write.parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    starts, total = [], offset
    for row in written.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # one row for each partition
        starts.append((row["_part"], total))
        total += row["n"]
    at = spark.createDataFrame(starts, "_part int, _start bigint")
    numbered = written.join(F.broadcast(at), "_part").withColumn(to, F.col("_start") + F.col("_place"))
    return numbered.select(*(c for c in vectors.columns if c != to), to)
