import pytest

from nearfield.operators.graph import GraphIndex
from nearfield.operators.inverted import IvfConfig
from nearfield.plans import jobs
from tests.conftest import uniform


@pytest.fixture(scope="module")
def tables(table):
    return table(uniform(300, 8, 1)), table(uniform(6, 8, 2), ("q_id", "q"))


def test_graph_job_builds_once_and_checks_what_it_reuses(spark, tables, tmp_path):
    base, queries = tables
    root, config = str(tmp_path / "g"), GraphIndex(8, 8, 40, shards=2)
    rows = jobs.graph(spark, base, queries, root, config, 5, (10, 300), 1)
    assert [(r["engine"], r["ef"]) for r in rows] == [("exact", None), ("graph", 10), ("graph", 300)]
    assert rows[0]["recall"] == rows[2]["recall"] == 1.0 and rows[1]["build_s"] > 0 and rows[0]["queries"] == 6
    again = jobs.graph(spark, base, queries, root, config, 5, (300,), 1)
    assert again[1]["build_s"] == 0 and again[1]["recall"] == 1.0
    with pytest.raises(ValueError, match="other settings"):
        jobs.graph(spark, base, queries, root, GraphIndex(8, 4, 40, shards=2), 5, (300,), 1)
    with pytest.raises(ValueError, match="holds 300 vectors"):
        jobs.graph(spark, base.limit(200), queries, root, config, 5, (300,), 1)


def test_inverted_job(spark, tables, tmp_path):
    base, queries = tables
    root, config = str(tmp_path / "i"), IvfConfig(8, 4, 4, 16, store_full_vectors=True)
    rows = jobs.inverted(spark, base, queries, root, config, 5, (300,), 300, 1, rounds=2, pq_rounds=2)
    assert [(r["budget"], r["rerank"]) for r in rows] == [(None, None), (300, 0), (300, 300)]
    assert rows[2]["recall"] == 1.0 and rows[1]["recall"] <= 1 and rows[1]["train_s"] > 0
    assert jobs.chosen(rows, 1.0)["rerank"] in (0, 300) and jobs.chosen(rows, 1.1) is None
    assert jobs.inverted(spark, base, queries, root, config, 5, (300,), 300, 1)[2]["train_s"] == 0
    with pytest.raises(ValueError, match="nlist"):
        jobs.inverted(spark, base, queries, root, IvfConfig(8, 5, 4, 16, store_full_vectors=True), 5, (300,), 300, 1)


@pytest.mark.parametrize("wrong", [["--k", "0"], ["--base", "x"], ["--at", "0"], ["--recall", "2"], ["--rerank", "-1"]])
def test_arguments(wrong):
    assert jobs.arguments(["graph", "--root", "r"]).k == 10
    with pytest.raises(SystemExit):
        jobs.arguments(["graph", "--root", "r", *wrong])


def test_settings(spark, tables):
    for more in ({"k": 0}, {"runs": 0}, {"efs": ()}, {"efs": (0,)}):
        with pytest.raises(ValueError):
            jobs.graph(spark, *tables, "unused", GraphIndex(8), **more)
    with pytest.raises(ValueError, match="reranking"):
        jobs.inverted(spark, *tables, "unused", IvfConfig(8, 4, 4, 16), rerank=5)
