import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import graph, knn, quantize
from nearfield.plans import evaluate
from nearfield.sources.storage import GraphStore
from tests.conftest import uniform


@pytest.fixture(scope="module")
def data():
    return uniform(400, 16, 3)


@pytest.fixture(scope="module")
def asked(table):
    return table(uniform(15, 16, 5), ("q_id", "q"))


def test_recall_and_beam(table, data, asked):
    index = graph.GraphIndex(16, 8, 60, shards=2)
    nodes = index.build(table(data)).cache()
    truth = knn.knn(table(data), asked, 10, "cosine")
    small, large = (evaluate.recall(index.search(nodes, asked, 10, ef), truth, 10).first().recall for ef in (10, 100))
    assert large >= 0.85 and large >= small - 0.02
    assert graph.one_way(nodes).count() == 0 and graph.over_degree(nodes, 8).count() == 0
    assert {r.id for r in index.search(nodes, table(data[:20], ("q_id", "q")), 1).filter("q_id = id").collect()} >= set(range(18))


def test_the_same_however_the_data_is_split(table, data):
    index = graph.GraphIndex(16, 8, 40, shards=3)
    one, many = (sorted(map(str, graph.edges(index.build(table(data[:150], partitions=n))).collect())) for n in (1, 5))
    assert one == many


def test_adding_in_parts_is_adding_at_once(table, data):
    index = graph.GraphIndex(16, 8, 40, shards=2)
    whole = index.build(table(data[:200]))
    parts = index.extend(index.build(table(data[:120])), table(data[120:200], first=120))
    assert sorted(map(str, graph.edges(whole).collect())) == sorted(map(str, graph.edges(parts).collect()))


def test_codes(table, data, asked, tmp_path, spark):
    pq = quantize.ProductQuantizer(16, 4, 16).train(table(data), 4)
    index = graph.GraphIndex(16, 8, 60, shards=2, pq=pq)
    nodes = index.build(table(data)).cache()
    got = index.search(nodes, asked, 10, 400, rerank=400).collect()
    want = {(r.q_id, r["rank"]): (r.id, r.distance) for r in knn.knn(table(data), asked, 10, "l2").collect()}
    assert sum(want[r.q_id, r["rank"]] == (r.id, r.distance) for r in got) >= 0.99 * len(got)
    a = index.visited(nodes, asked, 10, ef=50, rerank=100).select("q_id", "rank", "id", "nodes_visited").collect()
    b = index.visited(nodes, asked, 10, ef=100, rerank=100).select("q_id", "rank", "id", "nodes_visited").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(index, nodes)
    again, stored = store.load()
    key = lambda rows: sorted((r.q_id, r["rank"], r.id) for r in rows.collect())
    assert key(again.search(stored, asked, 10, 60)) == key(index.search(nodes, asked, 10, 60))
    assert graph.nodes(again.extend(stored, table(data[:30], first=1000)), 8).count() == 430


def test_shards_follow_the_size(table, data, spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 100)
    index = graph.GraphIndex(16, 8, 20)
    shards = index.build(table(data))
    assert index.shards == 4 and shards.count() == 4 and graph.graph_bytes(shards).first().nodes == 400


def test_a_stored_graph_is_searched_where_it_is_read(table, data, asked, spark, tmp_path):
    index = graph.GraphIndex(16, 8, 40, shards=3)
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(index, index.build(table(data[:120])))
    index, shards = store.load()
    plan = index.search(shards, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "vecs" not in plan.split("ReadSchema")[1]  # shortlists by query, no raw vectors
    whole = index.extend(shards, table(data[120:121], first=120))  # one row: the other shards keep every byte
    same = {r.shard: bytes(r.links) for r in shards.collect()}
    assert sum(bytes(r.links) == same[r.shard] for r in whole.collect()) == 2


def test_default_beam_on_more_vectors(table, found):
    """Recall against exact search at the default beam on 10,000 vectors."""
    data = uniform(10_000, 24, 11)
    index = graph.GraphIndex(24, 16, 60, shards=4)
    queries = table(uniform(30, 24, 12), ("q_id", "q"))
    recall = evaluate.recall(index.search(index.build(table(data, partitions=4)), queries, 10), knn.knn(table(data), queries, 10, "cosine"), 10).first().recall
    assert recall >= 0.9


def test_errors(table, data, asked):
    with pytest.raises(ValueError):
        graph.GraphIndex(0)
    index = graph.GraphIndex(16, 4, 20, shards=1)
    nodes = index.build(table(data[:20]))
    for wrong in ({"k": 0}, {"rerank": 5}, {"ef": 0}):
        with pytest.raises(ValueError):
            index.search(nodes, asked, **wrong)
    with pytest.raises(Exception, match="components"):
        index.build(table(uniform(5, 3, 1))).count()


def test_defaults(spark):
    assert graph.default_ef(1, 16) == 30 and graph.default_ef(10_000, 16) == int(16 * np.log2(10_000))
    levels = spark.range(20_000).select(graph.level(F.col("id"), 16).alias("l")).groupBy("l").count().collect()
    share = {r.l: r["count"] / 20_000 for r in levels}
    assert abs(share[0] - 15 / 16) < 0.01 and min(share) == 0


def test_a_full_beam_reaches_copies_and_far_groups(table):
    """More copies than a node has links, and groups far from each other: all rows are found, in the order of exact search."""
    rows = np.concatenate([np.repeat(uniform(2, 16, 7), 60, 0), uniform(40, 16, 8) + 50, uniform(40, 16, 9) - 50])
    asked = table(rows[::25], ("q_id", "q"))
    index = graph.GraphIndex(16, 2, 8, shards=1)
    shards = index.build(table(rows)).cache()
    assert graph.one_way(shards).count() == 0 and graph.over_degree(shards, 2).count() == 0
    key = lambda found: sorted((r.q_id, r["rank"], r.id, r.distance) for r in found.collect())
    assert key(index.search(shards, asked, 30, len(rows))) == key(knn.knn(table(rows), asked, 30, "cosine"))
    longer = index.extend(shards, table(rows[:50], first=1000)).cache()
    assert graph.one_way(longer).count() == 0 and graph.over_degree(longer, 2).count() == 0
    assert index.search(longer, asked, 500, 500).count() == asked.count() * 250


def test_a_full_beam_over_codes_reaches_copies(table):
    rows = np.concatenate([np.repeat(uniform(1, 16, 7), 90, 0), uniform(60, 16, 8)])
    asked = table(rows[::25], ("q_id", "q"))
    pq = quantize.ProductQuantizer(16, 4, 4).train(table(rows), 2)
    index = graph.GraphIndex(16, 2, 8, shards=2, pq=pq)
    shards = index.build(table(rows)).cache()
    key = lambda found: sorted((r.q_id, r["rank"], r.id, r.distance) for r in found.collect())
    assert key(index.search(shards, asked, 20, len(rows), len(rows))) == key(knn.knn(table(rows), asked, 20, "l2"))
    codes = table(rows).withColumn("codes", pq.encode(F.col("vec")))
    assert key(index.search(shards, asked, 20, len(rows))) == key(quantize.flat_search(codes, asked, pq, 20))


def test_a_part_whose_nodes_are_all_full_is_joined():
    """Two cliques with every place taken: a link on a circle makes room in each."""
    near = lambda node: lambda nodes: np.abs(nodes - node).astype(float)
    links = [[np.array([o for o in range(c, c + 5) if o != n])] for c in (0, 5) for n in range(c, c + 5)]
    shard = graph.Shard(2, [0] * 10, links, 0)
    shard.connect(near)
    assert (shard.parts() == 0).all() and max(len(own[0]) for own in links) <= 4
    assert all(n in links[o][0] for n, own in enumerate(links) for o in own[0])


def test_a_shortlist_of_everything_gives_k_rows_a_shard(table, monkeypatch):
    """With a shortlist that cuts nothing a shard gives no more than k rows for a query; a shorter one comes in parts of bounded size."""
    rows = uniform(300, 16, 7)
    pq = quantize.ProductQuantizer(16, 4, 4).train(table(rows), 1)
    index = graph.GraphIndex(16, 4, 8, shards=1, pq=pq)
    shard = index.build(table(rows)).first().asDict()
    ids = np.arange(20)
    monkeypatch.setattr(graph, "SHORT_ROWS", 900)
    assert sum(b.num_rows for b in index._asked(shard, ids, rows[:20], 300, 300, 5)) == 100
    for width, short in ((300, 290), (250, 250)):
        parts = [b.num_rows for b in index._asked(shard, ids, rows[:20], short, width, None)]
        assert max(parts) <= 900 and sum(parts) == 20 * short
