"""Registered queries over the vector table, each with DuckDB SQL for the same rows.

All models start deterministically (lowest ids, fixed rounds), distances are sums in double
from the first component to the last, and ties go to the smaller id, so both engines agree.
Rounded columns are rounded on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import clustering, graph, inverted, knn, quantize
from nearfield.plans import evaluate
from nearfield.plans.collections import Catalog
from nearfield.plans.sql import SQL
from nearfield.sources import datasets
from nearfield.sources.storage import GraphStore, IndexStore
from nearfield.sources.work import work_dir
from nearfield.streaming.ingest import ingest

EVERY, K, LISTS, BUDGET, PROBES, SUBSPACES, CODES = 50, 10, 16, 125, 4, 8, 16


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every row whose id is divisible by ``EVERY``."""
    return base(spark, sf_dir).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("q_id"), F.col("vec").alias("q"))


def checked(queries: DataFrame, numbers: int = 64) -> DataFrame:
    """Queries that a count allows to be sent to every executor."""
    if queries.count() * numbers * 8 > knn.BROADCAST_BYTES:
        raise ValueError("too many queries for a broadcast join")
    return F.broadcast(queries)


def rounded(found: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Doubles rounded as SQL's ``round`` does: the product with a power of ten, halves away from zero, not the decimal digits."""

    def near(column: str):
        whole = F.col(column).cast("double") * 10.0**digits
        return F.when(F.abs(whole) < float("inf"), F.round(whole) / 10.0**digits).otherwise(F.col(column).cast("double"))

    return found.withColumns({c: near(c) for c in columns})


def searched(found: DataFrame) -> DataFrame:
    return rounded(found.select("q_id", "rank", "id", "distance"), "distance")


# ---- exact search and vector functions


def exact(metric: str, k: int = K, kernel: str = "arrow", **more):
    return lambda spark, d: searched(knn.knn(base(spark, d), asked(spark, d), k, metric, kernel, **more))


def vec_norms(spark, d):
    v = F.col("vec")
    return rounded(base(spark, d).select("id", V.squared_norm(v).alias("squared"), V.norm(v).alias("norm")), "squared", "norm")


def normalized(function):
    return lambda spark, d: base(spark, d).select("id", F.posexplode(function(F.col("vec"))).alias("pos", "x")).select("id", "pos", F.round("x", 9).alias("x"))


def vec_split(spark, d):
    return base(spark, d).select("id", F.posexplode(V.split(F.col("vec"), SUBSPACES, 64 // SUBSPACES)).alias("subspace", "part")).select("id", "subspace", F.round(V.squared_norm(F.col("part")), 9).alias("squared"))


def range_count(spark, d):
    met = base(spark, d).crossJoin(checked(asked(spark, d)))
    return met.groupBy("q_id").agg(F.count_if(V.squared_l2(F.col("vec"), F.col("q")) <= 1.5).alias("n"))


def l2_by_norms(spark, d):
    met = base(spark, d).crossJoin(checked(asked(spark, d)))
    return met.select("q_id", "id", F.round(V.squared_l2_by_norms(F.col("vec"), F.col("q")), 9).alias("distance"))


def position_ids(spark, d):
    found = knn.with_position_ids(base(spark, d).withColumnRenamed("id", "vec_id").repartition(7), "vec_id", 100)
    return found.select("vec_id", "id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 9))


# ---- clustering


def centroids(spark, d, rounds, count=LISTS, **more):
    return clustering.kmeans(base(spark, d), count, rounds, None, 0.0, **more)


def centroid_rows(spark, found: np.ndarray) -> DataFrame:
    rows = [(c, p, float(x)) for c, v in enumerate(found) for p, x in enumerate(v)]
    return rounded(spark.createDataFrame(rows, "cluster_id int, pos int, x double"), "x")


def kmeans_assign(spark, d):
    return rounded(clustering.assign(base(spark, d), centroids(spark, d, 0)).select("id", "cluster_id", "centroid_distance"), "centroid_distance")


def kmeans_fit(rounds):
    return lambda spark, d: centroid_rows(spark, centroids(spark, d, rounds))


def kmeans_empty_retained(spark, d):
    start = clustering.start_centroids(base(spark, d), 4)
    start[3] = start[0]  # ties go to the first of the two, so the other stays empty
    return centroid_rows(spark, clustering.kmeans(base(spark, d), 4, 1, None, 0.0, start=start))


def kmeans_minibatch(mode):
    return lambda spark, d: centroid_rows(spark, clustering.kmeans(base(spark, d), 8, 4, None, 0.0, minibatch=200, mode=mode))


def cluster_histogram(spark, d):
    return clustering.histogram(clustering.assign(base(spark, d), centroids(spark, d, 3)), LISTS)


def two_nearest_margin(spark, d):
    first, second = F.col("centroid_distances")[0], F.col("centroid_distances")[1]
    found = inverted.margins(base(spark, d), centroids(spark, d, 0))
    return rounded(found.select("id", F.col("cluster_ids")[0].alias("first"), F.col("cluster_ids")[1].alias("second"), V.boundary_margin(first, second).alias("margin")), "margin")


def kmeans_shift(spark, d):
    a, b = centroids(spark, d, 2), centroids(spark, d, 3)
    return spark.createDataFrame([(float(np.abs(a - b).max()),)], "shift double").select(F.round("shift", 9).alias("shift"))


def assignment_mismatches(spark, d):
    found = centroids(spark, d, 1)
    rows = clustering.assign(base(spark, d), found).select("id", F.col("cluster_id").alias("a"))
    table = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(found)], "cluster_id int, centroid array<double>")
    met = base(spark, d).crossJoin(F.broadcast(table))  # sixteen centroids
    plain = met.groupBy("id").agg(F.min_by("cluster_id", F.struct(V.squared_l2(F.col("vec"), F.col("centroid")), "cluster_id")).alias("b"))
    return evaluate.mismatches(rows, plain)


# ---- product quantisation


def quantiser(spark, d, rounds=0, vectors=None):
    return quantize.ProductQuantizer(64, SUBSPACES, CODES, None).train(base(spark, d) if vectors is None else vectors, rounds, 0.0)


def encoded(spark, d, rounds=0):
    pq = quantiser(spark, d, rounds)
    return pq, base(spark, d).withColumn("codes", pq.encode(F.col("vec")))


def pq_encode(rounds=0):
    return lambda spark, d: encoded(spark, d, rounds)[1].select("id", F.posexplode("codes").alias("subspace", "code")).withColumn("code", F.col("code").cast("int"))


def pq_decode(spark, d):
    pq, rows = encoded(spark, d)
    return rows.select("id", F.posexplode(pq.decode(F.col("codes"))).alias("pos", "x")).select("id", "pos", F.round("x", 9).alias("x"))


def pq_recon_error(spark, d):
    pq, rows = encoded(spark, d)
    error = evaluate.reconstruction_error(rows.withColumn("decoded", pq.decode(F.col("codes"))))
    return error.select(F.round("error", 9).alias("error"))


def pq_adc_table(spark, d):
    pq = quantiser(spark, d)
    rows = asked(spark, d).select("q_id", F.posexplode(pq.distance_table(F.col("q"))).alias("subspace", "t"))
    return rows.select("q_id", "subspace", F.posexplode("t").alias("code", "distance")).select("q_id", "subspace", "code", F.round("distance", 9).alias("distance"))


def pq_flat_topk(rounds=0):
    def run(spark, d):
        pq, rows = encoded(spark, d, rounds)
        return searched(quantize.flat_search(rows, asked(spark, d), pq, K))

    return run


def pq_adc_column(spark, d):
    pq, rows = encoded(spark, d)
    tables = asked(spark, d).select("q_id", pq.distance_table(F.col("q")).alias("t"))
    met = rows.select("id", "codes").crossJoin(checked(tables, SUBSPACES * CODES))
    return searched(knn.best(met.select("q_id", "id", V.table_distance(F.col("codes"), F.col("t")).alias("distance")), K))


def pq_symmetric(spark, d):
    return rounded(quantiser(spark, d).symmetric_table(spark), "distance")


def pq_compression(spark, d):
    rows = [(m, quantize.ProductQuantizer(64, m, CODES).compression_ratio()) for m in (8, 16, 32)]
    return spark.createDataFrame(rows, "m int, ratio double")


# ---- inverted file


def ivf(spark, d, mode="standard", rounds=1, full=True, pq_rounds=0) -> inverted.IvfPq:
    config = inverted.IvfConfig(64, LISTS, SUBSPACES, CODES, None, full, pq_mode=mode)
    index = inverted.IvfPq(config)
    index.centroids = centroids(spark, d, rounds)
    index.pq = quantiser(spark, d, pq_rounds, index.residuals(base(spark, d)) if mode == "residual" else None)
    index.sizes = np.zeros(LISTS, np.int64)
    return index.add(base(spark, d))


def ivf_probe(**how):
    return lambda spark, d: rounded(ivf(spark, d).probes(asked(spark, d), **how), "centroid_distance")


def ivf_scanned(spark, d):
    return ivf(spark, d).scanned(asked(spark, d), max_candidates=BUDGET)


def ivf_search(mode="standard", pq_rounds=0, **how):
    return lambda spark, d: searched(ivf(spark, d, mode, pq_rounds=pq_rounds).search(asked(spark, d), K, **how))


def ivf_full_probe(spark, d):
    """Every list, and every record reranked."""
    index = ivf(spark, d)
    return searched(index.search(asked(spark, d), K, nprobe=LISTS, rerank=int(index.sizes.sum())))


def base_plus_delta_topk(spark, d):
    config = inverted.IvfConfig(64, LISTS, SUBSPACES, CODES, None, True)
    index = inverted.IvfPq(config, centroids(spark, d, 1), quantiser(spark, d), None, np.zeros(LISTS, np.int64))
    index.add(base(spark, d).filter("id < 400")).add(base(spark, d).filter("id >= 400"))
    return searched(index.search(asked(spark, d), K, nprobe=PROBES))


def replicated_candidates(spark, d):
    index = ivf(spark, d)
    count = base(spark, d).count() // 4
    lists = inverted.replicated(inverted.margins(base(spark, d), index.centroids), count)
    index.sizes = inverted.sizes_of(lists, LISTS)
    return inverted.candidates(lists, index.probes(asked(spark, d), max_candidates=BUDGET))


# ---- more rows: four-component vectors of order lines, standardised by fixed constants


def lines(spark, d) -> DataFrame:
    standard = [("l_quantity", 25.0, 15.0), ("l_extendedprice", 38000.0, 23000.0), ("l_discount", 0.05, 0.03), ("l_tax", 0.04, 0.025)]
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(*((F.col(c) - mean) / by for c, mean, by in standard)).alias("vec"))


def corners() -> np.ndarray:
    """The sixteen vectors of -1 and 1: component p of number i is bit p."""
    return np.array([[2.0 * (i >> p & 1) - 1 for p in range(4)] for i in range(16)])


def line_queries(spark, factor=0.5) -> DataFrame:
    return spark.createDataFrame([(i, [float(factor * x) for x in v]) for i, v in enumerate(corners())], "q_id bigint, q array<double>")


def lines_knn(spark, d):
    return searched(knn.knn(lines(spark, d), line_queries(spark), K, "l2"))


def lines_histogram(spark, d):
    rows = lines(spark, d)
    return clustering.histogram(clustering.assign(rows, clustering.kmeans(rows, LISTS, 2, None, 0.0, start=corners())), LISTS)


def lines_scanned(spark, d):
    """How many lists and records a budget reads."""
    rows = lines(spark, d)
    index = inverted.IvfPq(inverted.IvfConfig(4, LISTS, 2, CODES, None), clustering.kmeans(rows, LISTS, 1, None, 0.0, start=corners()), quantize.ProductQuantizer(4, 2, CODES, None).train(rows, 0), None, np.zeros(LISTS, np.int64))
    return index.add(rows).scanned(line_queries(spark), max_candidates=6000)


# ---- evaluation


def found_and_truth(spark, d):
    index = ivf(spark, d)
    return index, index.search(asked(spark, d), K, max_candidates=BUDGET, rerank=20), knn.knn(base(spark, d), asked(spark, d), K, "l2")


def recall(k):
    def run(spark, d):
        _, found, truth = found_and_truth(spark, d)
        return evaluate.recall(found, truth, k).select(F.round("recall", 6).alias("recall"), "queries")

    return run


def three_recalls(spark, d):
    index, _, truth = found_and_truth(spark, d)
    found = evaluate.stage_recalls(index, base(spark, d), asked(spark, d), truth, K, BUDGET, 20)
    return rounded(found, "routing_recall", "shortlist_recall", "final_recall", digits=6)


def precision_at_10(spark, d):
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    found = knn.knn(base(spark, d), asked(spark, d), K + 1, "cosine").filter("q_id <> id")
    return evaluate.label_precision(found.filter(F.col("rank") <= K + 1), labels).select(F.round("precision", 6).alias("precision"), "queries")


def latency_summary(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.abs("value") + 1).alias("ms"))
    return rounded(evaluate.latency_summary(rows, "ms"), "mean_ms", "p50_ms", "p95_ms", "p99_ms", "qps", digits=6)


CONFIGS = [
    ("a", 0.97, 9.0, 14.0, 100, 560, 10.0), ("b", 0.94, 5.0, 8.0, 200, 400, 8.0), ("c", 0.96, 8.0, 12.0, 120, 560, 12.0), ("d", 0.99, 9.5, 12.0, 200, 700, 9.0),
]


def config_rows(spark):
    return spark.createDataFrame(CONFIGS, "name string, recall_at_10 double, p50_ms double, p95_ms double, queries int, index_bytes long, build_s double")


def config_select(spark, d):
    return evaluate.select_config(config_rows(spark).filter("recall_at_10 >= 0.95 and queries >= 100"), ["index_bytes", "p95_ms", "build_s"])


SEEDS = [(n, mode, seed, 0.80 + 0.01 * n + (0.004 * seed if mode == "accumulated" else 0.0), 1.0 + n + (0.5 if mode == "accumulated" else 0.0)) for n in (1, 2) for mode in ("legacy", "accumulated") for seed in range(1, 3 + n - 1)]


def coarse_decision(spark, d):
    rows = spark.createDataFrame(SEEDS, "config int, coarse_training string, seed int, routing_recall double, train_s double")
    return rounded(evaluate.coarse_decision(rows, ["config"]), "gain", "legacy_s", "accumulated_s", digits=6)


def frontier(spark, d):
    """Cartesian sweep of settings as a table, and what each scans."""
    index = ivf(spark, d)
    settings = [(n, r) for n in (1, 2, 4, 8) for r in (0, 20)]
    truth = knn.knn(base(spark, d), asked(spark, d), K, "l2")
    parts = []
    for nprobe, rerank in settings:
        found = evaluate.recall(index.search(asked(spark, d), K, nprobe=nprobe, rerank=rerank), truth, K)
        parts.append(found.select(F.lit(nprobe).alias("nprobe"), F.lit(rerank).alias("rerank"), F.round("recall", 6).alias("recall")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- graphs

GRAPH = {"dim": 64, "m": 16, "ef_construction": 64}


def hnsw(spark, d, **more):
    index = graph.GraphIndex(**GRAPH, **more)
    return index, index.build(base(spark, d))


def hnsw_topk(spark, d):
    index, shards = hnsw(spark, d)
    return searched(index.search(shards, asked(spark, d), K))


def hnsw_full_beam(spark, d):
    """A beam as wide as the table: all that is connected is found."""
    index, shards = hnsw(spark, d)
    return searched(index.search(shards, asked(spark, d), K, base(spark, d).count()))


def hnsw_pq(spark, d):
    index, shards = hnsw(spark, d, pq=quantiser(spark, d))
    return searched(index.search(shards, asked(spark, d), K, 100))


def hnsw_pq_full_beam(rerank):
    def run(spark, d):
        index, shards = hnsw(spark, d, pq=quantiser(spark, d))
        every = base(spark, d).count()
        return searched(index.search(shards, asked(spark, d), K, every, every if rerank else 0))

    return run


def hnsw_recall(spark, d):
    """The share of the true neighbours that the default beam finds."""
    index, shards = hnsw(spark, d)
    return evaluate.recall(index.search(shards, asked(spark, d), K), knn.knn(base(spark, d), asked(spark, d), K, "cosine"), K).select(F.round("recall", 6).alias("recall"), "queries")


def hnsw_visited(spark, d):
    index, shards = hnsw(spark, d)
    return index.visited(shards, asked(spark, d), K).groupBy("q_id").agg(F.max("nodes_visited").alias("nodes_visited"), F.max("ef").alias("ef"))


def hnsw_levels(spark, d):
    return graph.nodes(hnsw(spark, d)[1], GRAPH["m"]).select("id", "level")


def hnsw_degree(spark, d):
    return graph.over_degree(hnsw(spark, d)[1], GRAPH["m"]).agg(F.count(F.lit(1)).alias("violations"))


def hnsw_reciprocity(spark, d):
    return graph.one_way(hnsw(spark, d)[1]).agg(F.count(F.lit(1)).alias("violations"))


def hnsw_size(spark, d):
    """Nodes, and the bytes of a graph less its edges': four for each node and four for each layer of one."""
    return graph.graph_bytes(hnsw(spark, d)[1]).select("nodes", (F.col("bytes") - 4 * F.col("edges")).alias("frame_bytes"))


def hnsw_stored(spark, d):
    index, shards = hnsw(spark, d, pq=quantiser(spark, d))
    store = GraphStore(spark, work_dir(spark, "graph"))
    store.save(index, shards)
    index, shards = store.load()
    every = base(spark, d).count()
    return searched(index.search(shards, asked(spark, d), K, every, every))


# ---- storage, collections, streams


def stored(spark, d, steps) -> IndexStore:
    """The index of ``ivf`` on disk, after some steps."""
    made = ivf(spark, d)
    store = IndexStore.create(spark, work_dir(spark, "index"), made.config)
    store.index.centroids, store.index.pq, store.index.sizes = made.centroids, made.pq, np.zeros(LISTS, np.int64)
    store._commit(trained=True, model=store._write_model(), sizes=[0] * LISTS)
    for step in steps:
        step(store)
    return IndexStore.load(spark, store.root)


def stored_topk(compact):
    def run(spark, d):
        rows = base(spark, d)
        steps = [lambda s: s.add(rows.filter("id < 300")), lambda s: s.add(rows.filter("id >= 300"))]
        if compact:
            steps.insert(1, lambda s: s.compact())
            steps.append(lambda s: s.compact())
        return searched(stored(spark, d, steps).search(asked(spark, d), K, nprobe=PROBES))

    return run


def streamed_topk(spark, d):
    """Vectors from a stream of files, one delta segment a micro-batch, then searched."""

    def step(store):
        source = f"{store.root}-source"
        base(spark, d).repartition(3).write.parquet(source)
        stream = spark.readStream.schema("id bigint, vec array<float>").option("maxFilesPerTrigger", 1).parquet(source)
        ingest(stream, store, f"{store.root}-checkpoint").awaitTermination()

    return searched(stored(spark, d, [step]).search(asked(spark, d), K, nprobe=PROBES))


def catalog(spark, d) -> Catalog:
    found = Catalog(spark, work_dir(spark, "collections"))
    found.create("items", 64, LISTS, pq_m=SUBSPACES, pq_k=CODES, store_full_vectors=True, pq_mode="residual", seed=None)
    found.train("items", base(spark, d), "accumulated", rounds=2, pq_rounds=2)
    found.add("items", base(spark, d))
    found.create("empty", 4, 2, pq_m=2, pq_k=2)
    return found


def collection_stats(spark, d):
    return catalog(spark, d).stats("items")


def collection_list(spark, d):
    found = catalog(spark, d)
    return Catalog(spark, found.root).list()


def collection_topk(spark, d):
    """Every list and every record reranked: the exact result."""
    return searched(catalog(spark, d).search("items", asked(spark, d), K, nprobe=LISTS, rerank=base(spark, d).count()))


def uniform_vectors(spark, d):
    rows = datasets.uniform(spark, 1000, 8, 3).select(F.explode("vec").alias("x"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min((F.col("x") >= 0) & (F.col("x") < 1)).alias("in_range"), (F.abs(F.avg("x") - 0.5) < 0.02).alias("centred"))


def dataset_check(spark, d):
    truth = knn.knn(base(spark, d), asked(spark, d), K, "l2").groupBy("q_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = datasets.check_benchmark(base(spark, d), asked(spark, d), truth, K)
    return spark.createDataFrame([(found["base"], found["queries"], found["dim"])], "base long, queries long, dim int")


QUERIES = {
    "knn_l2": exact("l2"),
    "knn_l2_columns": exact("l2", kernel="columns"),
    "knn_l2_grid": exact("l2", broadcast_bytes=0),
    "knn_cosine": exact("cosine"),
    "knn_cosine_columns": exact("cosine", kernel="columns"),
    "knn_dot": exact("dot"),
    "knn_k_gt_n": exact("l2", 1000),
    "vec_norms": vec_norms,
    "normalize": normalized(V.normalize),
    "normalize_rows": normalized(V.normalize_rows),
    "vec_split": vec_split,
    "range_count": range_count,
    "l2_by_norms": l2_by_norms,
    "position_ids": position_ids,
    "kmeans_assign": kmeans_assign,
    "kmeans_step": kmeans_fit(1),
    "kmeans_fit3": kmeans_fit(3),
    "kmeans_empty_retained": kmeans_empty_retained,
    "kmeans_minibatch": kmeans_minibatch("legacy"),
    "kmeans_accumulated": kmeans_minibatch("accumulated"),
    "kmeans_shift": kmeans_shift,
    "cluster_histogram": cluster_histogram,
    "two_nearest_margin": two_nearest_margin,
    "assignment_mismatches": assignment_mismatches,
    "pq_encode": pq_encode(),
    "pq_train2_encode": pq_encode(2),
    "pq_decode": pq_decode,
    "pq_recon_error": pq_recon_error,
    "pq_adc_table": pq_adc_table,
    "pq_adc_column": pq_adc_column,
    "pq_flat_topk": pq_flat_topk(),
    "pq_trained_topk": pq_flat_topk(2),
    "pq_symmetric": pq_symmetric,
    "pq_compression": pq_compression,
    "ivf_probe_nprobe": ivf_probe(nprobe=PROBES),
    "ivf_probe_budget": ivf_probe(max_candidates=BUDGET),
    "ivf_scanned": ivf_scanned,
    "ivf_adc_topk": ivf_search(nprobe=PROBES),
    "ivf_budget_topk": ivf_search(max_candidates=BUDGET),
    "ivf_residual_topk": ivf_search("residual", nprobe=PROBES),
    "ivf_rerank_topk": ivf_search(nprobe=PROBES, rerank=20),
    "ivf_residual_rerank_topk": ivf_search("residual", max_candidates=BUDGET, rerank=20),
    "ivf_trained_topk": ivf_search(pq_rounds=2, nprobe=PROBES, rerank=20),
    "ivf_full_probe_equals_exact": ivf_full_probe,
    "base_plus_delta_topk": base_plus_delta_topk,
    "replicated_candidates": replicated_candidates,
    "lines_knn": lines_knn,
    "lines_histogram": lines_histogram,
    "lines_scanned": lines_scanned,
    "recall_at_1": recall(1),
    "recall_at_10": recall(10),
    "three_recalls": three_recalls,
    "precision_at_10": precision_at_10,
    "latency_summary": latency_summary,
    "config_select": config_select,
    "coarse_decision": coarse_decision,
    "frontier": frontier,
    "hnsw_topk": hnsw_topk,
    "hnsw_full_beam": hnsw_full_beam,
    "hnsw_recall": hnsw_recall,
    "hnsw_visited": hnsw_visited,
    "hnsw_levels": hnsw_levels,
    "hnsw_degree": hnsw_degree,
    "hnsw_reciprocity": hnsw_reciprocity,
    "hnsw_size": hnsw_size,
    "hnsw_pq_topk": hnsw_pq,
    "hnsw_pq_full_beam": hnsw_pq_full_beam(False),
    "hnsw_pq_rerank": hnsw_pq_full_beam(True),
    "hnsw_stored": hnsw_stored,
    "stored_topk": stored_topk(False),
    "compacted_topk": stored_topk(True),
    "streamed_topk": streamed_topk,
    "collection_stats": collection_stats,
    "collection_list": collection_list,
    "collection_topk": collection_topk,
    "uniform_vectors": uniform_vectors,
    "dataset_check": dataset_check,
}

ORACLES = SQL
