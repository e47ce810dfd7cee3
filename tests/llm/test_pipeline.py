import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from nearfield.llm import exact, language, near, registry, shared
from tests.llm.test_bpe import ids_of
from tests.llm.test_near import brute, family


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(21)
    texts = [t for _ in range(10) for t in family(draw, draw.randint(20, 60), 3, 3)]
    texts += texts[:8] + [t.replace(" ", "  ") for t in texts[8:12]] + [None, "", "123 456", "!?"] + ["long " * 9000]
    draw.shuffle(texts)
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0]]  # a repeated row


@pytest.fixture(scope="module")
def folder(spark, rows, tables):
    return tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3))


def survivors(rows):
    """A plain version of the first three stages."""
    kept = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    seen, unique = set(), []
    for i, t in sorted(kept):
        key = exact.normal(t.encode())
        if key not in seen:
            seen.add(key)
            unique.append((i, t))
    return [unique[min(own)] for own in brute(unique)]


def test_equals_a_plain_version(spark, folder, rows):
    result = corpus_pipeline.run(spark, folder).collect()
    want = survivors(rows)
    assert {r.doc_id for r in result} == {i for i, _ in want}
    ids = {i: [*ids_of(t), 2] for i, t in want}
    assert sum(r.length for r in result) == sum(map(len, ids.values()))
    for r in result:
        part = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])
        assert zlib.crc32(part) == r.ids_crc32


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        again = docs.write.mode("overwrite").parquet(f"{folder}-{name}")
        docs = spark.read.parquet(f"{folder}-{name}")
        assert again is None


def test_nothing(spark, folder, tables):
    empty = tables(documents=spark.read.parquet(f"{folder}/documents.parquet").limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_clean_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language_stage(spark, docs, folder)
    assert docs.filter(docs.text.rlike(r"\p{L}")).count() == kept.count()


def test_settled_tables_have_no_marker(spark):
    """Each marker would fork the driver's JVM twice."""
    table = shared.settled(spark.range(5).toDF("id"))
    names = os.listdir(table._settled_path.removeprefix("file://"))
    assert table.count() == 5 and any(n.endswith(".parquet") for n in names) and not [n for n in names if "_SUCCESS" in n]
    shared.release(table)
    assert not os.path.exists(table._settled_path.removeprefix("file://"))


def test_registered(spark):
    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "packing"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    frame = entry.queries()[name](spark, folder)
    result = duck.execute(entry.oracle_sql()[name])
    names, columns = [d[0] for d in result.description], sorted(frame.columns)
    assert sorted(names) == columns
    assert sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall()) == sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())


def test_language_holds_out_by_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.learn(docs.filter(~registry.held_out()).select("doc_id", "text", "lang"))
    assert model.family.names == ["germanic"]
    assert docs.filter(registry.held_out()).count() > 0 and near.SIMILAR == 0.8
    assert F is not None
