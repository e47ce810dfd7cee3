"""Runnable evaluations: build an index or reuse a stored one, ask it, report recall and times.

``python -m nearfield.plans.jobs graph|inverted --root FOLDER [--base PATH --queries PATH]``; without
tables, hash-uniform vectors are generated. ``base`` is [id, vec] and ``queries`` [q_id, q].

A row of a report is one setting. ``batch_s`` is the best of ``runs`` batches of all queries, and
``ms_per_query`` its share of one query: Spark answers batches, not single queries, so percentiles of single
queries aren't reported. Truth is the exact search. Only report rows reach the driver.

A stored index is reused only if it was built with the same settings and holds as many vectors as
``base``; anything else is an error before any work, and the folder is left as it is.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.graph import GraphIndex
from nearfield.operators.inverted import IvfConfig
from nearfield.operators.knn import check_k, knn
from nearfield.plans import evaluate
from nearfield.sources import datasets
from nearfield.sources.storage import GraphStore, IndexStore


def seconds(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def same(stored: dict, asked: dict, held: int, rows: int) -> None:
    """An error unless a stored index is the one that would be built."""
    other = {name: (stored[name], value) for name, value in asked.items() if stored[name] != value}
    if other:
        raise ValueError(f"the stored index has other settings (stored, asked): {other}")
    if held != rows:
        raise ValueError(f"the stored index holds {held} vectors, the base {rows}: unfinished or of another table")


def measured(search: Callable[[], DataFrame], truth: DataFrame, k: int, runs: int) -> dict:
    """Recall of a search and the time of its best batch."""
    batch = min(seconds(lambda: search().write.format("noop").mode("overwrite").save()) for _ in range(runs))
    row = evaluate.recall(search(), truth, k).first()
    return {"recall": row.recall, "queries": row.queries, "batch_s": batch, "ms_per_query": 1000 * batch / max(1, row.queries)}


def checked(k: int, runs: int, *settings: list[int]) -> None:
    check_k(k)
    if k <= 0 or runs <= 0:
        raise ValueError("k and runs must be positive")
    if any(not values or min(values) <= 0 for values in settings):
        raise ValueError("every list of settings needs positive values")


def graph(spark: SparkSession, base: DataFrame, queries: DataFrame, root: str, config: GraphIndex, k: int = 10, efs: tuple[int, ...] = (50, 100, 200), runs: int = 2) -> list[dict]:
    """Exact search by cosine against a stored graph at several beams: first the exact row, then one for each beam."""
    checked(k, runs, list(efs))
    if config.pq is not None:
        raise ValueError("this job compares graphs over vectors")
    store, built = GraphStore(spark, root), 0.0
    try:
        index, shards = store.load()
    except FileNotFoundError:
        built = seconds(lambda: store.save(config, config.build(base)))
        index, shards = store.load()
    else:
        if index.pq is not None:
            raise ValueError("the stored index has other settings: it is over codes")
        names = ["dim", "m", "ef_construction", "seed", "store_full_vectors", *["shards"] * (config.shards is not None)]
        same(vars(index), {n: getattr(config, n) for n in names}, shards.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], base.count())
    truth = knn(base, queries, k, "cosine").persist()
    exact = measured(lambda: knn(base, queries, k, "cosine"), truth, k, runs)
    rows = [{"engine": "exact", "ef": None, "build_s": 0.0, **exact}]
    rows += [{"engine": "graph", "ef": ef, "build_s": built, **measured(lambda ef=ef: index.search(shards, queries, k, ef), truth, k, runs)} for ef in efs]
    truth.unpersist()
    return rows


def inverted(spark: SparkSession, base: DataFrame, queries: DataFrame, root: str, config: IvfConfig, k: int = 10, budgets: tuple[int, ...] = (5_000, 20_000), rerank: int = 100, runs: int = 2, **training) -> list[dict]:
    """Exact search against a stored inverted file at several probe budgets, by codes and, with stored vectors, reranked."""
    checked(k, runs, list(budgets))
    if rerank < 0 or rerank and not config.store_full_vectors:
        raise ValueError("reranking needs stored vectors and a number that isn't negative")
    times = {"train_s": 0.0, "build_s": 0.0}
    if IndexStore(spark, root).exists():
        store = IndexStore.load(spark, root)
        same(asdict(store.index.config), asdict(config), int(store.index.sizes.sum()), base.count())
    else:
        store = IndexStore.create(spark, root, config)
        times = {"train_s": seconds(lambda: store.train(base, **training)), "build_s": seconds(lambda: store.add(base))}
    truth = knn(base, queries, k, "l2").persist()
    rows = [{"engine": "exact", "budget": None, "rerank": None, "train_s": 0.0, "build_s": 0.0, **measured(lambda: knn(base, queries, k, "l2"), truth, k, runs)}]
    for budget in budgets:
        for depth in sorted({0, rerank}):
            search = lambda: store.search(queries, k, max_candidates=budget, rerank=depth)  # noqa: B023, E731
            rows.append({"engine": "inverted", "budget": budget, "rerank": depth, **times, **measured(search, truth, k, runs)})
    truth.unpersist()
    return rows


def chosen(rows: list[dict], recall: float = 0.9) -> dict | None:
    """Of the index's settings that reach this recall, the fastest; None if none does."""
    enough = [r for r in rows if r["engine"] != "exact" and r["recall"] >= recall]
    return min(enough, key=lambda r: r["batch_s"], default=None)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="nearfield.plans.jobs")
    parser.add_argument("engine", choices=("graph", "inverted"))
    parser.add_argument("--root", required=True, help="folder of the stored index, shared by driver and executors")
    parser.add_argument("--base", help="Parquet [id, vec]")
    parser.add_argument("--queries", help="Parquet [q_id, q]")
    for name, value in (("rows", 100_000), ("asked", 100), ("dim", 64), ("k", 10), ("runs", 2), ("m", 16), ("ef-construction", 200), ("nlist", 256), ("pq-m", 16), ("train-rounds", 10)):
        parser.add_argument(f"--{name}", type=int, default=value)
    parser.add_argument("--at", type=int, nargs="+", help="beams of a graph, budgets of an inverted file")
    parser.add_argument("--rerank", type=int, default=100)
    parser.add_argument("--recall", type=float, default=0.9)
    found = parser.parse_args(given)
    if (found.base is None) != (found.queries is None):
        parser.error("--base and --queries go together")
    positive = ("rows", "asked", "dim", "k", "runs", "m", "ef_construction", "nlist", "pq_m", "train_rounds")
    if wrong := [n for n in positive if getattr(found, n) <= 0]:
        parser.error(f"must be positive: {', '.join(wrong)}")
    if found.at and min(found.at) <= 0 or found.rerank < 0 or not 0 <= found.recall <= 1:
        parser.error("--at must be positive, --rerank not negative and --recall from 0 to 1")
    return found


def main(given: list[str] | None = None) -> list[dict]:
    a = arguments(given)
    spark = SparkSession.builder.appName("nearfield evaluation").getOrCreate()
    if a.base:
        base, queries = spark.read.parquet(a.base).select("id", "vec"), spark.read.parquet(a.queries).select("q_id", "q")
        dim = base.agg(F.max(F.size("vec"))).first()[0] or a.dim
    else:
        base, dim = datasets.uniform(spark, a.rows, a.dim, 0), a.dim
        queries = datasets.uniform(spark, a.asked, a.dim, 1).selectExpr("id as q_id", "vec as q")
    if a.engine == "graph":
        rows = graph(spark, base, queries, a.root, GraphIndex(dim, a.m, a.ef_construction), a.k, tuple(a.at or (50, 100, 200)), a.runs)
    else:
        config = IvfConfig(dim, a.nlist, a.pq_m, store_full_vectors=True)
        rows = inverted(spark, base, queries, a.root, config, a.k, tuple(a.at or (5_000, 20_000)), a.rerank, a.runs, rounds=a.train_rounds, pq_rounds=a.train_rounds)
    for row in rows:
        print(json.dumps(row))
    print(json.dumps({"chosen": chosen(rows, a.recall)}))
    return rows


if __name__ == "__main__":
    main()
