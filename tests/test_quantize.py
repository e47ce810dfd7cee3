import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import knn, quantize
from nearfield.plans import evaluate
from tests.conftest import uniform


def trained(table, data, m, k, rounds=8):
    return quantize.ProductQuantizer(data.shape[1], m, k).train(table(data), rounds)


def test_compression_ratio():
    assert quantize.ProductQuantizer(64, 8, 256).compression_ratio() == 32


def test_reconstruction_beats_chance(table):
    data = uniform(1000, 32, 0)
    pq = trained(table, data, 8, 64)
    rows = table(data).withColumn("decoded", pq.decode(pq.encode(F.col("vec"))))
    chance = np.linalg.norm(data - data[np.random.default_rng(1).permutation(len(data))], axis=1).mean()
    assert evaluate.reconstruction_error(rows).first().error < 0.5 * chance


def test_table_distance_is_the_decoded_distance(table):
    data, queries = uniform(300, 32, 1), uniform(3, 32, 2)
    pq = trained(table, data, 4, 32, 3)
    rows = table(data).withColumn("codes", pq.encode(F.col("vec"))).withColumn("decoded", pq.decode(F.col("codes")))
    tables = table(queries, ("q_id", "q")).withColumn("t", pq.distance_table(F.col("q")))
    met = rows.crossJoin(F.broadcast(tables))  # three queries
    got = met.select(V.table_distance(F.col("codes"), F.col("t")).alias("a"), V.squared_l2(F.col("decoded"), F.col("q")).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in got)


def test_symmetric_distance_is_decoded_too(spark, table):
    data = uniform(80, 16, 3)
    pq = trained(table, data, 4, 16, 3)
    books = spark.createDataFrame([(pq.codebooks.tolist(),)], "books array<array<array<double>>>")
    rows = table(data).withColumn("codes", pq.encode(F.col("vec"))).crossJoin(F.broadcast(books))  # one row
    first = rows.filter("id = 0").select(F.col("codes").alias("other"))
    got = rows.crossJoin(F.broadcast(first)).select(quantize.symmetric_distance(F.col("codes"), F.col("other"), F.col("books")).alias("d"), "codes", "other").collect()
    sums = {(r["subspace"], r["first"], r["second"]): r.distance for r in pq.symmetric_table(spark).collect()}
    assert all(abs(r.d - sum(sums[s, a, b] for s, (a, b) in enumerate(zip(r.codes, r.other)))) < 1e-9 for r in got)


def test_recall_grows_with_subspaces(table, found):
    data, queries = uniform(1200, 32, 4), uniform(20, 32, 5)
    asked = table(queries, ("q_id", "q"))
    exact = found(knn.knn(table(data), asked, 10, "l2"))
    recalls = []
    for m in (4, 8, 16):
        pq = trained(table, data, m, 64, 5)
        got = found(quantize.flat_search(table(data).withColumn("codes", pq.encode(F.col("vec"))), asked, pq, 10))
        recalls.append(sum(len(set(got[q]) & set(exact[q])) for q in exact) / 200)
    assert recalls == sorted(recalls) and recalls[-1] >= 0.5


def test_errors(table):
    for wrong in ({"m": 5}, {"m": 0}, {"k": 257}, {"k": 0}):
        with pytest.raises(ValueError):
            quantize.ProductQuantizer(16, **{"m": 4, "k": 8, **wrong})
    with pytest.raises(ValueError):
        trained(table, uniform(7, 16, 6), 4, 8)
    with pytest.raises(RuntimeError):
        quantize.ProductQuantizer(16, 4, 8).encode(F.col("vec"))
    pq = trained(table, uniform(20, 16, 6), 4, 8, 1)
    with pytest.raises(ValueError):
        quantize.flat_search(table(uniform(2, 16, 7)), table(uniform(2, 16, 7), ("q_id", "q")), pq, 0)


def test_codes_fit_a_smallint(table):
    data = uniform(300, 4, 8)
    pq = trained(table, data, 1, 256, 0)
    codes = [r.codes[0] for r in table(data).select(pq.encode(F.col("vec")).alias("codes")).collect()]
    assert min(codes) >= 0 and max(codes) > 127
