import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import exact, registry
from tests.llm.conftest import ODD


def brute(rows):
    texts = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    out = []
    for d, t in texts:
        same = sorted((e for e, u in texts if u == t), key=lambda e: (e is not None, e or 0))
        out.append((str(d), str(same[0]), len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def got(result):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in result)


def test_odd_rows(spark, odd, nothing, tables):
    rows = registry.op6_exact(spark, tables(documents=odd)).collect()
    assert got(rows) == brute(ODD)
    groups = {}
    for r in rows:
        groups.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(kept) == 1 for kept in groups.values())
    assert registry.op6_exact(spark, tables(documents=nothing)).count() == 0


def test_white_space(spark):
    rows = [(1, "a b"), (2, "a \t\n b"), (3, " a b"), (4, "a b"), (5, "a b "), (6, "a\x0bb"), (7, "ab"), (8, "A b"), (9, "a\x1cb")]
    assert got(exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


@given(st.binary(max_size=5000), st.binary(max_size=5000))
def test_fingerprints_compose(a, b):
    assert exact.combine(exact.fingerprint(a), exact.fingerprint(b), len(b)) == exact.fingerprint(a + b)
    value = int.from_bytes  # the definition: base-r digits modulo a prime
    for h, base, prime in zip(exact.fingerprint(a), exact.BASES, exact.PRIMES):
        want = 0
        for byte in a:
            want = (want * base + byte) % prime
        assert h == want
    assert value(b"", "little") == 0


def test_huge_texts_are_hashed_in_slices(spark, monkeypatch):
    rows = [(1, "ab  é" * 500), (2, "ab \n é" * 500), (3, "ab é" * 499), (4, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = exact.mark(frame, "doc_id", "text").drop("row").collect()
    monkeypatch.setattr(exact, "HUGE", 100)
    monkeypatch.setattr(exact, "SLICE", 37)
    cut = exact.mark(frame, "doc_id", "text").drop("row").select(*whole[0].__fields__).collect()
    assert sorted(whole) == sorted(cut)
    assert got(exact.deduplicate(frame).collect()) == brute(rows)


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """With a fingerprint that often collides, the comparison still tells the texts apart."""
    rows = [(i, f"text {i % 7}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = exact.mark(frame, "doc_id", "text").withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(2).cast("long"))
    clash = lambda data: (1, 2)
    differing = exact.collisions(frame, "text", None, lambda batches, wanted: exact._sent(batches, wanted, clash))
    assert differing.count() == 6
    assert got(exact.deduplicate(frame, marks=marks, differing=differing).collect()) == brute(rows)


def test_comparison_by_chunks():
    a = bytes(range(256)) * 2000
    assert exact.same(a, bytes(a)) and not exact.same(a, a[:-1] + b"x") and not exact.same(a, a[:-1]) and exact.same(b"", b"")


def test_a_hot_text_is_sent_once_a_task(spark):
    frame = spark.createDataFrame([(i, "the same text") for i in range(1000)], "doc_id long, text string").repartition(3)
    sent = frame.select("text").mapInArrow(lambda batches: exact._sent(batches), exact.SCHEMA)
    assert sent.count() <= 3


def test_only_repeated_fingerprints_are_sent(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(500, "text 7"), (501, "text \t7"), (502, "text 9")]
    wanted = exact.repeated(exact.mark(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    texts = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    sent = [r for batch in exact._sent([texts], wanted) for r in batch.column("data").to_pylist()]
    assert sorted(set(sent)) == [b"text 7", b"text 9"] and wanted.sum() == 2


def test_texts_that_differ_in_one_chunk(monkeypatch):
    """Three long texts of one fingerprint, compared chunk by chunk as tasks would see them."""
    monkeypatch.setattr(exact, "SENT", 10)
    long = b"x" * 95
    texts = [long, long[:40] + b"y" + long[41:], long, long[:94] + b"z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = [r for b in exact._sent([batch], None, lambda data: (1, 2)) for r in b.to_pylist()]
    assert len(rows) == 30 and max(len(r["data"]) for r in rows) == 10
    rows.sort(key=lambda r: (r["at"], r["sha"]))
    table = pa.RecordBatch.from_pylist(rows, schema=exact._SENT)
    found = {r for b in exact._differing([table.slice(0, 13), table.slice(13)]) for r in b.column("sha").to_pylist()}
    hashes = sorted(hashlib.sha256(t).hexdigest() for t in set(texts))
    assert found <= set(hashes[1:]) and len(found) == 2


@pytest.mark.parametrize("text", ["", "a", "\x00", "\x00\x00", "\x00a"])
def test_length_tells_leading_zeros_apart(text):
    assert (*exact.fingerprint(text.encode()), len(text)) != (*exact.fingerprint(("\x00" + text).encode()), len(text) + 1)
