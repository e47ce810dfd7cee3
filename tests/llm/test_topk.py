import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import registry, topk


def brute(rows, k, scale=64):
    usable = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("cell", F.lit("c")).repartition(3)


def got(result):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect())


@pytest.mark.parametrize(("block", "dense"), [(7, 1 / 32), (2048, 2.0), (64, 0.0)])
def test_equals_brute_force(spark, monkeypatch, block, dense):
    monkeypatch.setattr(topk, "DENSE", dense)  # lists one by one, or as products
    draw = np.random.default_rng(1)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(draw.normal(size=(300, 16)))]
    rows += [(300 + i, rows[3][1]) for i in range(60)]  # a common vector: ties
    monkeypatch.setattr(topk, "BLOCK", block)
    assert got(topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, 20)


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.25]), (6, []), (20, [-0.01, 0.3, 0.7]), (7, [0.5, -0.5])]
    assert got(topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=3)) == brute(rows, 3)


def test_repeated_rows_and_shares(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 100)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    draw = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(120, 4)).round(1))]
    assert got(topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5)) == brute(rows, 5)
    twice = [*rows[:40], *rows[:40]]
    found = got(topk.top_k(frame(spark, twice), F.col("vec_id") % 20 == 0, k=5))
    assert found == brute(twice, 5)


def test_scoring_stops_only_on_proof():
    draw = np.random.default_rng(3)
    vectors = np.floor(64 * draw.normal(size=(3000, 64)) / 8)
    queries, ids = vectors[:40], np.arange(3000)
    best, skipped = topk.Best(40, 5), 0
    for start in range(0, 3000, 500):
        own = slice(start, start + 500)
        block = topk.Block.of(ids[own], vectors[own])
        assert (topk.Block.read(*block.row()).dense() == vectors[own]).all()
        skipped += topk.search_block(block, queries, ids[:40], best, 0)
    assert skipped > 0
    exact = queries @ vectors.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    for q in range(40):
        order = np.lexsort((ids, -exact[q]))[:5]
        assert best.ids[q].tolist() == order.tolist() and best.scores[q].tolist() == exact[q, order].tolist()


def test_lists_are_ordered_by_impact():
    block = topk.Block.of(np.arange(3), np.array([[8.0, -1.0], [3.0, 9.0], [0.0, 2.0]]))
    assert list(zip(block.levels, block.components, block.counts)) == [(4, 0, 1), (4, 1, 1), (2, 0, 1), (2, 1, 1), (1, 1, 1)]
    assert block.vectors.tolist() == [0, 1, 1, 2, 0] and block.values.tolist() == [8, 9, 3, 2, -1]


def test_large_components_are_exact(spark):
    """Whole numbers beyond what doubles tell apart, and beyond 64 bits, are ranked exactly."""
    draw = np.random.default_rng(7)
    rows = [(i, (draw.normal(size=6) * 10.0 ** draw.choice([0, 7, 8, 12, 30, 38])).clip(-3e38, 3e38)) for i in range(120)]
    rows += [(200, [2e8, 1.0]), (220, [2e8, 1.0]), (201, [2e8, 1.015625]), (202, [3e38] * 6), (203, [-3e38] * 6)]
    big = topk.LARGEST
    want = [(q, n, i, max(-big, min(big, s))) for q, n, i, s in brute(rows, 20)]
    assert got(topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0)) == want


def test_a_null_key_takes_no_part(spark):
    rows = frame(spark, [(0, [1.0]), (1, [2.0])]).withColumn("vec_id", F.when(F.col("vec_id") == 0, F.col("vec_id")))
    assert got(topk.top_k(rows, F.col("vec_id") % 20 == 0)) == []


def test_empty_table_and_query(spark, tables):
    empty = frame(spark, [(0, [1.0])]).limit(0)
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(i, [i / 10, 1.0]) for i in range(30)]
    assert got(registry.op3_topk(spark, tables(embeddings=frame(spark, rows)))) == brute(rows, 20)
