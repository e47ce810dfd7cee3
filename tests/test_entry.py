"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from nearfield.plans import catalogue, evaluate

FOLDER = "/root/testdata/sf0.01"
TABLES = "embeddings events lineitem"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted((str(tuple(plain(r[c]) for c in columns)) for r in frame.collect()))
    assert rows
    if name == "hnsw_recall":
        assert frame.first().recall >= 0.9
    if name in catalogue.ORACLES:
        result = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["q_id", "rank", "id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_targets(spark):
    rows = evaluate.passes(catalogue.config_rows(spark)).collect()
    assert {r.name for r in rows if r.passes_target} == {"a", "c", "d"}


def test_long_vectors_are_rounded_as_in_sql(spark, tmp_path):
    """Distances of some millions have no more than nine digits after the point: the last one is SQL's too."""
    drawn = np.random.default_rng(3).normal(size=(700, 64)).astype(np.float32) * 200
    rows = pa.table({"vec_id": np.arange(700), "embedding": pa.array(list(drawn), pa.list_(pa.float32())), "label": pa.array([0] * 700, pa.int32())})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    got = entry.queries()["hnsw_pq_rerank"](spark, str(tmp_path)).select("q_id", "rank", "id", "distance").collect()
    want = duck.execute(entry.oracle_sql()["hnsw_pq_rerank"]).fetchall()
    assert len(want) == 140 and sorted(map(tuple, got)) == sorted(want)


def test_rounding_is_that_of_sql(spark):
    values = [0.0, 0.5e-9, -0.5e-9, 1.0000000005, 2.5, 1e15 / 3, -1e18 / 7, 1e300, float("inf"), float("nan"), None, *(np.random.default_rng(4).random(2000) * 3e6).tolist()]
    got = [r.x for r in catalogue.rounded(spark.createDataFrame([(x,) for x in values], "x double").coalesce(1), "x").collect()]
    want = [duckdb.execute("select round(?::double, 9)", [x]).fetchone()[0] for x in values]
    assert list(map(repr, got)) == [repr(0.0 if x == 0 else x) for x in want]
