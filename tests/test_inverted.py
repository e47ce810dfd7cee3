import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import inverted, knn
from nearfield.plans import evaluate
from tests.conftest import clustered, uniform


def built(table, data, nlist=16, m=4, k=16, full=True, **config):
    index = inverted.IvfPq(inverted.IvfConfig(data.shape[1], nlist, m, k, 0, full, **config)).train(table(data), rounds=5, pq_rounds=4)
    return index.add(table(data))


@pytest.fixture(scope="module")
def data():
    return clustered(800, 16, 41)


@pytest.fixture(scope="module")
def asked(table):
    return table(clustered(12, 16, 41), ("q_id", "q"))


@pytest.mark.parametrize("mode", ["standard", "residual"])
def test_all_lists_and_all_reranked_is_exact(table, found, data, asked, mode):
    index = built(table, data, pq_mode=mode)
    got = index.search(asked, 10, nprobe=16, rerank=len(data)).collect()
    want = knn.knn(table(data), asked, 10, "l2").collect()
    key = lambda r: (r.q_id, r["rank"])
    assert [(r.id, r.distance) for r in sorted(got, key=key)] == [(r.id, r.distance) for r in sorted(want, key=key)]


def test_recall_grows_with_probes(table, found, data, asked):
    index, truth = built(table, data), knn.knn(table(data), asked, 10, "l2")
    recalls = [evaluate.recall(index.search(asked, 10, nprobe=n, rerank=200), truth, 10).first().recall for n in (1, 4, 16)]
    assert recalls == sorted(recalls) and recalls[-1] > 0.9


def test_budget_is_the_shortest_prefix_that_holds_it(table, data, asked):
    index = built(table, data)
    rows = index.probes(asked, max_candidates=125).collect()
    for q in {r.q_id for r in rows}:
        held = [r.n for r in sorted((r for r in rows if r.q_id == q), key=lambda r: r.probe)]
        assert sum(held) >= 125 > sum(held[:-1])
    assert index.probes(asked, max_candidates=10**9).groupBy("q_id").count().filter("count <> 16").count() == 0


def test_routing_defaults_and_conflicts(table, data, asked):
    index = built(table, data)
    assert index.probes(asked).groupBy("q_id").count().first()["count"] == 8
    assert index.probes(asked, nprobe=99).count() == 12 * 16
    for wrong in ({"nprobe": 1, "max_candidates": 1}, {"nprobe": 0}, {"max_candidates": 0}):
        with pytest.raises(ValueError):
            index.probes(asked, **wrong)


def test_scanned_is_the_probed_lists_size(table, data, asked):
    index = built(table, data)
    sizes = index.sizes
    assert sizes.sum() == len(data)
    probes = index.probes(asked, nprobe=3).groupBy("q_id").agg(F.collect_list("cluster_id").alias("c")).collect()
    want = {r.q_id: int(sum(sizes[c] for c in r.c)) for r in probes}
    assert {r.q_id: r.scanned for r in index.scanned(asked, nprobe=3).collect()} == want


def test_batches_equal_one_add(table, found, data, asked):
    whole = built(table, data)
    parts = inverted.IvfPq(whole.config, whole.centroids, whole.pq, None, np.zeros(16, np.int64))
    for start in range(0, 800, 400):
        parts.add(table(data[start : start + 400], first=start))
    assert found(parts.search(asked, 5)) == found(whole.search(asked, 5)) and (parts.sizes == whole.sizes).all()


def test_errors(table, data, asked):
    with pytest.raises(RuntimeError):
        inverted.IvfPq(inverted.IvfConfig(16, 4, 4, 8)).probes(asked)
    for wrong in ({"pq_mode": "x"}, {"routing_backend": "x"}, {"coarse_training": "x"}, {"pq_m": 5}, {"nlist": 0}):
        with pytest.raises(ValueError):
            inverted.IvfConfig(**{"dim": 16, "nlist": 4, "pq_m": 4, "pq_k": 8, **wrong})
    index = built(table, data[:100], 4, full=False)
    for wrong in ({"k": 0}, {"rerank": -1}, {"rerank": 5}):
        with pytest.raises(ValueError):
            index.search(asked, **wrong)
    with pytest.raises(Exception, match="components"):
        index.search(table(uniform(1, 5, 1), ("q_id", "q")), 1).count()
    with pytest.raises(ValueError):
        inverted.IvfPq(inverted.IvfConfig(16, 50, 4, 8)).train(table(data[:20]))


def test_empty_index_gives_nothing(table, data, asked):
    index = inverted.IvfPq(inverted.IvfConfig(16, 4, 4, 8, store_full_vectors=True)).train(table(data[:100]), rounds=1, pq_rounds=1)
    assert index.search(asked, 5, rerank=5).count() == 0


def test_replicas_add_candidates(table, data, asked):
    index = built(table, data)
    margins = inverted.margins(table(data), index.centroids)
    lists = inverted.replicated(margins, 200)
    assert lists.count() == 1000
    before = inverted.candidates(margins.select("id", F.col("cluster_ids")[0].alias("cluster_id")), index.probes(asked, nprobe=2))
    after = inverted.candidates(lists, index.probes(asked, nprobe=2))
    assert before.join(after, ["q_id", "id"], "left_anti").count() == 0 and after.count() == after.distinct().count()


def test_three_recalls_fall(table, data, asked):
    index, truth = built(table, data), knn.knn(table(data), asked, 10, "l2")
    row = evaluate.stage_recalls(index, table(data), asked, truth, 10, 125, 25).first()
    assert row.routing_recall >= row.shortlist_recall >= row.final_recall > 0


def test_only_probed_lists_are_read(table, data, asked):
    index = built(table, data)
    plan = inverted.probed(index.postings, [1, 2])._jdf.queryExecution().optimizedPlan().toString()
    assert "cluster_id" in plan and "IN (1,2)" in plan


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_a_shortlist_beyond_all_records_needs_no_room_for_it(table, data, asked):
    """12 billion places were made for 800 records: exact distances decide at once, of the probed lists only."""
    index, columns = built(table, data), ("q_id", "rank", "id", "distance")
    everything = rows_of(index.search(asked, 10, nprobe=16, rerank=10**9), *columns)
    assert everything == rows_of(knn.knn(table(data), asked, 10, "l2"), *columns)
    assert rows_of(index.search(asked, 10, nprobe=2, rerank=10**9), *columns) == rows_of(index.search(asked, 10, nprobe=2, rerank=600), *columns)
    lists = inverted.candidates(index.postings, index.probes(asked, nprobe=2))
    assert {r[::2] for r in rows_of(index.search(asked, 10**9, nprobe=2, rerank=1), "q_id", "rank", "id")} == set(rows_of(lists, "q_id", "id"))


def test_shortlists_too_long_to_keep(table, data, asked):
    """Shortlists that a task can't keep are ranked by Spark: the same rows."""
    index, columns = built(table, data), ("q_id", "rank", "id", "distance", "exact")
    assert rows_of(index.shortlist(asked, 10**9, 3, rerank=True), *columns) == rows_of(index.shortlist(asked, 800, 3, rerank=True), *columns)
    assert rows_of(index.search(asked, 10**9, nprobe=3), *columns[:4]) == rows_of(index.search(asked, 800, nprobe=3), *columns[:4])
