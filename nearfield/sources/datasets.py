"""Vector data sets: generators, checks, and sinks for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(spark: SparkSession, count: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``count`` vectors of U(0, 1) floats, each from a hash of its id: the same however it is split."""
    component = lambda i: ((F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), i), 40)).cast("double") / float(1 << 24)).cast("float")
    rows = spark.range(count) if partitions is None else spark.range(0, count, 1, partitions)
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component).alias("vec"))


def clustered(spark: SparkSession, count: int, dim: int, clusters: int = 8, spread: float = 0.15, seed: int = 0) -> DataFrame:
    """Vectors around ``clusters`` centres: a centre's hash-uniform components plus a spread of noise."""
    part = lambda key, i, salt: F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + salt), i), 40).cast("double") / float(1 << 24)
    component = lambda i: (4 * part(F.col("id") % clusters, i, 1) + spread * (part(F.col("id"), i, 2) * 2 - 1)).cast("float")
    return spark.range(count).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component).alias("vec"))


def check_benchmark(base: DataFrame, queries: DataFrame, neighbours: DataFrame, k: int = 10) -> dict[str, int]:
    """Check the three tables of a benchmark: equal dimensions, a truth list of at least k for each query."""
    b = base.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")).first()
    q = queries.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("q")).alias("low"), F.max(F.size("q")).alias("high")).first()
    t = neighbours.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("ids")).alias("low")).first()
    if not b.n or not q.n or len({b.low, b.high, q.low, q.high}) != 1:
        raise ValueError("base and queries need rows of one dimension")
    if t.n != q.n or t.low < k:
        raise ValueError(f"every query needs {k} true neighbours")
    return {"base": b.n, "queries": q.n, "dim": b.low}


def with_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Found rows with their labels [id, label]."""
    return found.join(labels, "id", "left")


def write_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A small result table as one JSON-lines or CSV file."""
    if kind not in ("json", "csv"):
        raise ValueError("kind must be 'json' or 'csv'")
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
