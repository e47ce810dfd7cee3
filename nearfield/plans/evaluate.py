"""Evaluation as joins and aggregations: recall, precision, latencies, choice of settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import squared_l2


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """[recall, queries]: of each query's k true neighbours, the share found among its first k.

    With k = 1 the first of both must be the same row.
    """
    wanted = truth.filter(F.col("rank") <= k).select("q_id", "id")
    hits = wanted.join(found.filter(F.col("rank") <= k).select("q_id", "id").distinct(), ["q_id", "id"], "left_semi")
    count = truth.select("q_id").distinct().agg(F.count(F.lit(1)).alias("queries"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(count).select((F.col("hits") / (F.lit(k) * F.col("queries"))).alias("recall"), "queries")  # one row each


def routing_hits(index, base: DataFrame, queries: DataFrame, truth: DataFrame, budget: int) -> DataFrame:
    """True neighbours whose list is probed: (q_id, id)."""
    from nearfield.operators.clustering import assign

    lists = assign(base.join(truth.select("id").distinct(), "id", "left_semi"), index.centroids).select("id", "cluster_id")
    probes = index.probes(queries, max_candidates=budget).select("q_id", "cluster_id")
    return truth.join(lists, "id").join(probes, ["q_id", "cluster_id"], "left_semi").select("q_id", "id")


def stage_recalls(index, base: DataFrame, queries: DataFrame, truth: DataFrame, k: int, budget: int, rerank: int) -> DataFrame:
    """One row: shares of true neighbours that routing, the code shortlist and the final result keep."""
    truth = truth.filter(F.col("rank") <= k)
    short = index.shortlist(queries, max(k, rerank), None, budget, bool(rerank)).select("q_id", "id")
    final = index.search(queries, k, max_candidates=budget, rerank=rerank).select("q_id", "id")
    total = truth.agg(F.count(F.lit(1)).alias("total"))
    counts = [
        routing_hits(index, base, queries, truth, budget).agg(F.count(F.lit(1)).alias("routing_recall")),
        truth.join(short, ["q_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("shortlist_recall")),
        truth.join(final, ["q_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("final_recall")),
    ]
    row = reduce(DataFrame.crossJoin, counts, total)  # one row each
    return row.select(*((F.col(c) / F.col("total")).alias(c) for c in ("routing_recall", "shortlist_recall", "final_recall")))


def label_precision(found: DataFrame, labels: DataFrame) -> DataFrame:
    """[precision, queries]: share of found rows with their query's label."""
    named = found.join(labels.select("id", F.col("label").alias("found_label")), "id").join(labels.select(F.col("id").alias("q_id"), "label"), "q_id")
    return named.agg(F.avg((F.col("found_label") == F.col("label")).cast("double")).alias("precision"), F.countDistinct("q_id").alias("queries"))


def reconstruction_error(decoded: DataFrame) -> DataFrame:
    """[error]: mean Euclidean distance of vec and decoded."""
    return decoded.agg(F.avg(F.sqrt(squared_l2(F.col("vec"), F.col("decoded")))).alias("error"))


def latency_summary(rows: DataFrame, ms: str) -> DataFrame:
    """Mean, interpolated percentiles and serial throughput of a column of milliseconds."""
    p50, p95, p99 = (F.percentile(ms, F.lit(p)).alias(name) for p, name in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean_ms"), p50, p95, p99, (1000 / F.avg(ms)).alias("qps"))


def mismatches(first: DataFrame, second: DataFrame) -> DataFrame:
    """[rows, mismatches] of two assignments [id, a] and [id, b]."""
    return first.join(second, "id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("mismatches"))


def select_config(rows: DataFrame, least: list[str]) -> DataFrame:
    """The row that is least in these columns, in this order."""
    return rows.orderBy(*least).limit(1)


def passes(rows: DataFrame, recall: float = 0.95, p50_ms: float = 10.0, p95_ms: float = 20.0, queries: int = 100) -> DataFrame:
    """Rows with ``passes_target``: enough recall and queries, low enough latencies."""
    return rows.withColumn("passes_target", (F.col("recall_at_10") >= recall) & (F.col("p50_ms") <= p50_ms) & (F.col("p95_ms") <= p95_ms) & (F.col("queries") >= queries))


def coarse_decision(rows: DataFrame, config: list[str], gain: float = 0.005, seeds: int = 3) -> DataFrame:
    """Per setting: mean routing gain of accumulated over legacy training on shared seeds, if these are enough."""
    side = lambda mode: rows.filter(F.col("coarse_training") == mode).select(*config, "seed", F.col("routing_recall").alias(f"{mode}_recall"), F.col("train_s").alias(f"{mode}_train"))
    both = side("legacy").join(side("accumulated"), [*config, "seed"])
    means = both.groupBy(*config).agg(F.count(F.lit(1)).alias("seeds"), F.avg(F.col("accumulated_recall") - F.col("legacy_recall")).alias("gain"), F.avg("legacy_train").alias("legacy_s"), F.avg("accumulated_train").alias("accumulated_s"))
    return means.filter(F.col("seeds") >= seeds).withColumn("promote", F.col("gain") >= gain)
