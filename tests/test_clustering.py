import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import clustering
from tests.conftest import clustered, uniform


def lloyd(data, centroids, rounds):
    data, centroids = data.astype(np.float64), centroids.astype(np.float64)
    for _ in range(rounds):
        own = ((data[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        centroids = np.stack([data[own == c].mean(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
    return centroids


def test_equals_lloyd(table):
    data = clustered(400, 8, 1)
    got = clustering.kmeans(table(data), 8, 4, None, 0.0)
    assert np.allclose(got, lloyd(data, data[:8], 4), atol=1e-9)


def test_the_same_however_the_data_is_split(table):
    data = clustered(300, 8, 2)
    one, many = (clustering.kmeans(table(data, partitions=n), 6, 3, 5) for n in (1, 7))
    assert (one == many).all()


def test_empty_cluster_stays(table):
    data = uniform(50, 4, 3)
    start = np.vstack([data[:2], np.full((1, 4), 99.0)])
    assert (clustering.kmeans(table(data), 3, 2, None, start=start)[2] == 99.0).all()


def test_stops_when_nothing_moves(table):
    data = np.repeat(np.eye(3, dtype=np.float32), 5, axis=0)
    assert np.allclose(clustering.kmeans(table(data), 3, 50, None, start=np.eye(3)), np.eye(3))


def test_modes_agree_with_full_rounds_and_differ_in_minibatches(table):
    data = clustered(300, 8, 4)
    full = [clustering.kmeans(table(data), 5, 3, 1, 0.0, mode=m) for m in clustering.MODES]
    assert (full[0] == full[1]).all()
    small = [clustering.kmeans(table(data), 5, 5, 1, 0.0, minibatch=60, mode=m) for m in clustering.MODES]
    assert np.isfinite(small).all() and (small[0] != small[1]).any()


def test_errors(table):
    with pytest.raises(ValueError):
        clustering.kmeans(table(uniform(3, 4, 5)), 4)
    with pytest.raises(ValueError):
        clustering.kmeans(table(uniform(3, 4, 5)), 2, mode="other")


def test_histogram_has_empty_clusters(table):
    assigned = clustering.assign(table(uniform(20, 4, 6)), np.vstack([np.zeros((1, 4)), np.full((1, 4), 50.0)]))
    assert sorted((r.cluster_id, r.n) for r in clustering.histogram(assigned, 2).collect()) == [(0, 20), (1, 0)]


def test_nearest_ties_go_to_the_lowest_number(table):
    rows = clustering.assign(table(np.zeros((4, 2))), np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]])).collect()
    assert {r.cluster_id for r in rows} == {0}


@pytest.mark.parametrize("seed", [None, 3])
def test_large_samples_are_the_small_ones(table, monkeypatch, seed):
    rows = table(uniform(200, 2, 7), partitions=5)
    small = sorted(r.id for r in clustering.first_rows(rows, 60, seed).collect())
    monkeypatch.setattr(clustering, "TOP_K", 10)
    large = clustering.first_rows(rows, 60, seed)
    assert large.columns == ["id", "vec"] and sorted(r.id for r in large.collect()) == small


@pytest.mark.parametrize("seed", [None, 3])
def test_samples_of_wide_rows_have_the_size_asked_for(spark, seed):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(60_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(1).cast("float")).alias("vec"))
        sample = clustering.first_rows(rows, 30_000, seed).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = sorted(r.id for r in sample)
    assert len(set(ids)) == 30_000 and all(len(r.vec) == 64 for r in sample)
    assert ids == list(range(30_000)) or seed is not None


def test_one_id_may_hold_most_rows(table, monkeypatch):
    monkeypatch.setattr(clustering, "TOP_K", 10)
    rows = table(uniform(80, 2, 8), partitions=4).withColumn("id", F.when(F.col("id") < 60, F.lit(-5)).otherwise(F.col("id")))
    got = [r.id for r in clustering.first_rows(rows, 65).collect()]
    assert sorted(got) == [-5] * 60 + list(range(60, 65)) and clustering.first_rows(rows, 30).filter("id = -5").count() == 30
    assert clustering.first_rows(rows, 500).count() == 80


def test_batches_are_windows(table):
    rows = table(uniform(50, 2, 9), partitions=4)
    got = [sorted(r.id for r in b.collect()) for b in clustering.batches_of(rows, 20, 4, None)]
    assert got == [list(range(20)), list(range(20, 40)), [*range(10), *range(40, 50)], list(range(10, 30))]
    assert [b.count() for b in clustering.batches_of(rows, 20, 2, 7)] == [20, 20]
