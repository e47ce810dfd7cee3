import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.inverted import IvfConfig
from nearfield.plans.collections import Catalog, Conflict, Invalid, NotFound
from nearfield.sources import datasets
from nearfield.sources.storage import IndexStore
from nearfield.streaming.ingest import ingest
from tests.conftest import clustered, uniform

HOW = {"rounds": 3, "pq_rounds": 2}


def made(spark, path, table, data, **config):
    store = IndexStore.create(spark, str(path), IvfConfig(data.shape[1], 8, 4, 16, store_full_vectors=True, **config))
    store.train(table(data), **HOW)
    return store


def test_reload_append_compact(spark, table, found, tmp_path):
    data = clustered(500, 16, 1)
    asked = table(data[:8], ("q_id", "q"))
    store = made(spark, tmp_path / "i", table, data)
    assert store.total_vectors() == 0
    store.add(table(data[:300]))
    before = found(store.search(asked, 5, rerank=20))
    store = IndexStore.load(spark, str(tmp_path / "i"))
    assert found(store.search(asked, 5, rerank=20)) == before
    assert not store.is_compacted and store.compact()["vectors"] == 300 and store.is_compacted
    assert found(store.search(asked, 5, rerank=20)) == before
    store.add(table(data[300:], first=300))
    full = found(store.search(asked, 5, rerank=20))
    assert not store.is_compacted and store.total_vectors() == 500
    store = IndexStore.load(spark, str(tmp_path / "i"))
    store.compact()
    assert found(IndexStore.load(spark, str(tmp_path / "i")).search(asked, 5, rerank=20)) == full
    assert len(store.files.names("segments")) == 1


def test_training_drops_postings(spark, table, tmp_path):
    data = clustered(200, 16, 2)
    store = made(spark, tmp_path / "i", table, data)
    store.add(table(data))
    store.train(table(data), **HOW)
    assert store.total_vectors() == 0 and store.files.names("segments") == []


def test_only_the_probed_ranges_are_opened(spark, table, tmp_path, monkeypatch):
    """A search of few lists opens few of a segment's files; a delta's too."""
    from nearfield.sources import storage

    monkeypatch.setattr(storage, "RANGE", 100)
    data = clustered(600, 16, 3)
    store = IndexStore.create(spark, str(tmp_path / "r"), IvfConfig(16, 64, 4, 16, 0, True))
    store.train(table(data), **HOW)
    store.add(table(data))
    store.add(table(data, first=1000))
    every, few = store.index.postings.inputFiles(), store.lists(np.array([1, 2, 3])).inputFiles()
    assert 0 < len(few) <= len(every) // 8
    rows = lambda frame: sorted((r.cluster_id, r.id) for r in frame.collect())
    assert rows(store.lists(np.array([1, 2, 3]))) == rows(store.index.postings.filter("cluster_id in (1, 2, 3)"))
    assert store.lists(np.array([], dtype=int)).count() == 0


def test_memory_does_not_grow(spark, table, tmp_path):
    store = made(spark, tmp_path / "i", table, clustered(200, 16, 4))
    sizes = []
    for n in range(2):
        store.add(table(clustered(200, 16, 4), first=200 * n))
        sizes.append(store.logical_bytes())
    assert sizes[0]["resident_memory_bytes"] == sizes[1]["resident_memory_bytes"]
    assert sizes[1]["posting_bytes"] == 2 * sizes[0]["posting_bytes"] and store.disk_bytes() >= store.posting_bytes() > 0


def test_a_second_writer_fails(spark, table, tmp_path):
    data = clustered(100, 16, 5)
    first = made(spark, tmp_path / "i", table, data)
    second = IndexStore.load(spark, str(tmp_path / "i"))
    first.add(table(data))
    with pytest.raises(FileExistsError):
        second.add(table(data))


def test_unknown_format(spark, tmp_path):
    store = IndexStore.create(spark, str(tmp_path / "i"), IvfConfig(4, 2, 2, 4))
    store.files.publish("manifest-00000009.json", '{"format": 99}')
    with pytest.raises(ValueError):
        IndexStore.load(spark, str(tmp_path / "i"))


def test_collections(spark, table, found, tmp_path):
    catalog, data = Catalog(spark, str(tmp_path / "c")), uniform(50, 8, 0)
    catalog.create("a", 8, 5, pq_m=4, pq_k=8, pq_mode="residual", store_full_vectors=True)
    with pytest.raises(Conflict):
        catalog.create("a", 8, 5, pq_m=4, pq_k=8)
    for early in (lambda: catalog.add("a", table(data)), lambda: catalog.search("a", table(data, ("q_id", "q"))), lambda: catalog.compact("a")):
        with pytest.raises(Invalid):
            early()
    catalog.train("a", table(data), "accumulated", **HOW)
    with pytest.raises(Conflict):
        catalog.train("a", table(data))
    assert catalog.add("a", table(data[:20])) == 20
    got = found(catalog.search("a", table(data[:3], ("q_id", "q")), 1, nprobe=5, rerank=20))
    assert got == {0: [0], 1: [1], 2: [2]}
    catalog.compact("a")
    again = Catalog(spark, str(tmp_path / "c"))
    row = again.stats("a").first()
    assert (row.total_vectors, row.trained, row.compacted, row.pq_mode, row.coarse_training) == (20, True, True, "residual", "accumulated")
    assert [tuple(r) for r in again.list().collect()] == [("a", 20)]
    again.drop("a")
    assert Catalog(spark, str(tmp_path / "c")).list().count() == 0


def test_collection_errors(spark, table, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    for wrong in ({"pq_m": 3}, {"routing_backend": "x"}, {"pq_mode": "x"}, {"pq_k": 300}, {"other": 1}):
        with pytest.raises(Invalid):
            catalog.create("b", 4, 2, **{"pq_m": 2, "pq_k": 2, **wrong})
    for bad in ("../x", "a b", ""):
        with pytest.raises(Invalid):
            catalog.create(bad, 4, 2, pq_m=2, pq_k=2)
    with pytest.raises(NotFound):
        catalog.stats("none")
    catalog.create("b", 4, 2, pq_m=2, pq_k=2)
    with pytest.raises(Invalid):
        catalog.train("b", table(uniform(10, 3, 1)))
    with pytest.raises(Invalid):
        catalog.train("b", table(uniform(1, 4, 1)))
    with pytest.raises(Invalid):
        catalog.train("b", table(uniform(10, 4, 1)), "x")
    catalog.train("b", table(uniform(10, 4, 1)), **HOW)
    with pytest.raises(Invalid):
        catalog.add("b", table(uniform(2, 4, 1)).limit(0))
    asked = table(uniform(2, 4, 1), ("q_id", "q"))
    for wrong in ({"k": 0}, {"nprobe": 1, "max_candidates": 2}, {"rerank": 3}):
        with pytest.raises(Invalid):
            catalog.search("b", asked, **wrong)
    assert [e.code for e in (Invalid, NotFound, Conflict)] == [400, 404, 409]


def test_stream(spark, table, tmp_path):
    data = clustered(200, 16, 6)
    store = made(spark, tmp_path / "i", table, data)
    table(data, partitions=4).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("id bigint, vec array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest(stream, store, str(tmp_path / "check"), compact_every=2).awaitTermination()

    run()
    assert store.total_vectors() == 200 and len(store.manifest["segments"]) <= 2
    run()
    assert store.total_vectors() == 200
    assert store.add(table(data), ("ingest", 0)) is False and store.add(table(data), ("other", 0)) is True


def test_data_sets(spark, table, tmp_path):
    rows = datasets.uniform(spark, 300, 4, 1)
    again = datasets.uniform(spark, 300, 4, 1, partitions=7)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))
    assert datasets.clustered(spark, 20, 4).count() == 20
    truth = spark.createDataFrame([(0, list(range(10)))], "q_id bigint, ids array<bigint>")
    one = table(uniform(1, 4, 1), ("q_id", "q"))
    assert datasets.check_benchmark(rows, one, truth) == {"base": 300, "queries": 1, "dim": 4}
    with pytest.raises(ValueError):
        datasets.check_benchmark(rows, table(uniform(1, 5, 1), ("q_id", "q")), truth)
    with pytest.raises(ValueError):
        datasets.check_benchmark(rows, one, truth, 11)
    for kind in ("json", "csv"):
        datasets.write_results(spark.range(3), str(tmp_path / kind), kind)
        assert getattr(spark.read, kind)(str(tmp_path / kind)).count() >= 3
    with pytest.raises(ValueError):
        datasets.write_results(spark.range(3), str(tmp_path / "x"), "x")
    assert datasets.with_labels(spark.createDataFrame([(1, 1)], "q_id long, id long"), spark.createDataFrame([(1, "a")], "id long, label string")).first().label == "a"
    assert np.isfinite([x for r in rows.select(F.explode("vec").alias("x")).collect() for x in r]).all()


def test_a_collection_reranks_everything_in_bounded_room(spark, table, tmp_path):
    """A shortlist of a billion for each query: the exact result, of two segments."""
    from nearfield.operators.knn import knn

    data = clustered(500, 16, 1)
    found = Catalog(spark, str(tmp_path))
    found.create("a", 16, 8, pq_m=4, pq_k=16, store_full_vectors=True, pq_mode="residual")
    found.train("a", table(data), **HOW)
    found.add("a", table(data[:300]))
    found.add("a", table(data[300:], first=300))
    asked = table(data[:40], ("q_id", "q"))
    key = lambda rows: sorted((r.q_id, r["rank"], r.id, r.distance) for r in rows.collect())
    assert key(found.search("a", asked, 10, nprobe=8, rerank=10**9)) == key(knn(table(data), asked, 10, "l2"))
