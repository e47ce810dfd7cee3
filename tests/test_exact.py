import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import kernels, knn
from tests.conftest import uniform


def truth(base, queries, k, metric):
    base, queries = base.astype(np.float64), queries.astype(np.float64)
    if metric == "l2":
        d = ((queries[:, None] - base[None]) ** 2).sum(2)
    elif metric == "dot":
        d = -(queries @ base.T)
    else:
        d = 1 - (queries / (np.linalg.norm(queries, axis=1)[:, None] + 1e-10)) @ (base / (np.linalg.norm(base, axis=1)[:, None] + 1e-10)).T
    return {q: np.lexsort((np.arange(len(base)), d[q]))[:k].tolist() for q in range(len(queries))}


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("how", [{}, {"kernel": "columns"}, {"broadcast_bytes": 0}])
def test_equals_brute_force(table, found, metric, how):
    base, queries = uniform(300, 16, 1), uniform(12, 16, 2)
    result = knn.knn(table(base), table(queries, ("q_id", "q")), 7, metric, **how)
    assert found(result) == truth(base, queries, 7, metric)


def test_self_match_and_clamp(table, found):
    base = uniform(5, 4, 3)
    result = knn.knn(table(base), table(base, ("q_id", "q")), 100).collect()
    assert len(result) == 25
    assert all(r.id == r.q_id and r.distance < 1e-6 for r in result if r["rank"] == 1)


def test_equal_distances_go_to_the_smaller_id(table, found):
    base = np.tile(uniform(1, 8, 4), (50, 1))
    for how in ({}, {"kernel": "columns"}, {"broadcast_bytes": 0}):
        assert found(knn.knn(table(base), table(base[:2], ("q_id", "q")), 5, "l2", **how)) == {0: [0, 1, 2, 3, 4], 1: [0, 1, 2, 3, 4]}


def test_ids_may_repeat(spark, table, found):
    base = table(uniform(4, 4, 5)).unionByName(table(uniform(4, 4, 5)))
    assert knn.knn(base, table(uniform(1, 4, 6), ("q_id", "q")), 8, "l2").count() == 8


def test_empty_tables(spark, table):
    empty = spark.createDataFrame([], "id bigint, vec array<float>")
    queries = table(uniform(2, 4, 7), ("q_id", "q"))
    assert knn.knn(empty, queries, 3, "l2").count() == 0
    assert knn.knn(table(uniform(2, 4, 7)), queries.limit(0), 3, "l2").count() == 0


def test_wrong_arguments(table):
    base, queries = table(uniform(4, 4, 8)), table(uniform(2, 4, 8), ("q_id", "q"))
    with pytest.raises(ValueError):
        knn.knn(base, queries, 0)
    with pytest.raises(ValueError):
        knn.knn(base, queries, 1, "l1")
    with pytest.raises(Exception, match="components"):
        knn.knn(base, table(uniform(2, 5, 8), ("q_id", "q")), 1).count()
    with pytest.raises(ValueError):
        knn.knn(base, queries, 1, kernel="columns", broadcast_bytes=8)


def test_partial_limit_before_the_shuffle(table):
    plan = knn.knn(table(uniform(30, 4, 9)), table(uniform(2, 4, 9), ("q_id", "q")), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_normalisers(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        V.normalize(F.col("a")).alias("n"), V.normalize_rows(F.col("a")).alias("r"), V.normalize_rows(F.col("z")).alias("z"), V.cosine_distance(F.col("a"), F.col("z")).alias("d")
    ).first()
    assert row.n == pytest.approx([0.6, 0.8]) and row.r == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.d == 1.0


def test_dimension_guard(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert rows.select(V.has_dimension(F.col("v"), 2).alias("v")).first().v == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3 components"):
        rows.select(V.has_dimension(F.col("v"), 3).alias("v")).collect()


def test_positions_follow_the_order(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("key")).repartition(5)
    got = knn.with_position_ids(rows, "key", 1000).collect()
    assert sorted((r.key, r.id) for r in got) == [(i, 1000 + i) for i in range(100)]


def test_columns_scale_each_vector_once(table):
    """Norms belong to rows, not to pairs of them: above the join there is an inner product and no root."""
    data = uniform(60, 8, 1)
    data[3] = 0
    asked = table(data[:5], ("q_id", "q"))
    found = knn.knn(table(data), asked, 7, "cosine", kernel="columns")
    above, join, below = found._jdf.queryExecution().executedPlan().toString().partition("BroadcastNestedLoopJoin")
    assert join and "sqrt" not in above.lower() and "sqrt" in below.lower()
    key = lambda rows: sorted((r.q_id, r["rank"], r.id, r.distance) for r in rows.collect())
    assert key(found) == key(knn.knn(table(data), asked, 7, "cosine"))


def test_a_norm_is_computed_once_a_vector(spark):
    """The division, done for each component, holds no sum over all of them."""
    for function in (V.normalize, V.normalize_rows):
        plan = spark.range(1).select(function(F.array(F.col("id"), F.lit(2.0))).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.lower().count("sqrt") == 1 and "/ aggregate" not in plan.lower() and "/ (sqrt" not in plan.lower() and "/ greatest" not in plan.lower()


@pytest.mark.parametrize("alike", ["equal", "scaled"])
def test_a_very_common_vector_takes_bounded_room(monkeypatch, alike):
    """Copies, or vectors that products can't tell apart: few pairs get their exact distance at a time, and the result is that of all pairs."""
    base, queries, k = uniform(3000, 8, 1).astype(np.float64), uniform(300, 8, 2).astype(np.float64), 10
    base[::2] = base[0] if alike == "equal" else base[0] * np.arange(1000, 2500)[:, None]
    queries = base[0] + 0.01 * queries
    ids, rows, real = np.random.default_rng(3).permutation(len(base)), [], kernels.exact
    monkeypatch.setattr(kernels, "exact", lambda a, b, metric: rows.append(len(a)) or real(a, b, metric))
    state = kernels.Nearest(queries, k, "cosine")
    for part in np.split(np.arange(len(base)), 2):
        state.add(ids[part], base[part])
    assert max(rows) <= 1 << 16 and (alike != "equal" or sum(rows) < 1 << 16)
    far = 1.0 - kernels.running_sum(kernels.prepared(queries, "cosine")[:, None, i] * kernels.prepared(base, "cosine")[None, :, i] for i in range(8))
    for query, own in enumerate(far):
        order = np.lexsort((ids, own))[:k]
        assert state.ids[query].tolist() == ids[order].tolist() and (state.distances[query] == own[order]).all()
