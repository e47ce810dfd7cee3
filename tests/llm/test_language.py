import random
import zlib

import pytest
from pyspark.sql import functions as F

from nearfield.llm import language, registry

SYLLABLES = {"en": "th ing er on ly the and of", "de": "sch ung keit der und ein ich auf", "fr": "eau tion que les oui ment é è", "es": "ción ado que los ñ rr el osa", "xx": "zk qw vj kx zz qq jv wk"}


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(5)
    rows = []
    for i in range(600):
        lang = draw.choice(list(SYLLABLES))
        words = ["".join(draw.choice(SYLLABLES[lang].split()) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(8, 60))]
        rows.append((i, " ".join(words).capitalize(), lang if i % 13 else None, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, truth string")


def test_held_out_accuracy(spark, documents, tables):
    found = registry.op4_language(spark, tables(documents=documents)).join(documents.select("doc_id", "truth"), "doc_id").collect()
    assert len(found) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.truth for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_predictions_use_the_text_alone(documents):
    model = language.learn(documents)
    a = language.predict(documents.select("doc_id", "text"), model).select("doc_id", "language.*")
    b = language.predict(documents.withColumn("lang", F.lit("en")).withColumn("doc_id", -F.col("doc_id")), model).select((-F.col("doc_id")).alias("doc_id"), "language.*")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_texts(spark, documents, odd, nothing):
    model = language.learn(documents)
    rows = {(r.doc_id, r.text): r.language for r in language.predict(odd, model).collect()}
    assert {rows[k].lang for k in ((1, None), (2, ""), (3, " \t\n"))} == {"und"} and rows[1, None].score == 0
    assert all(v.lang != "und" for k, v in rows.items() if k[1] and k[1].strip())
    assert model("12 !? 34") == ("und", 0.0)
    assert language.predict(nothing, model).count() == 0


def test_nothing_and_one_language_to_learn(spark, documents, nothing):
    assert language.learn(nothing)("text") == ("und", 0.0)
    assert language.learn(documents.filter("lang = 'de'"))("some text") == ("de", 1.0)
    assert language.learn(documents.withColumn("text", F.lit(None).cast("string")))("text") == ("und", 0.0)


def test_family_first(documents):
    model = language.learn(documents)
    assert set(model.within) == {"germanic", "romance", "xx"} and set(model.within["romance"].names) == {"es", "fr"}


def test_sample_is_bounded(documents, monkeypatch):
    rows = documents.filter("lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("order"), F.col("doc_id").alias("key"))
    monkeypatch.setattr(language, "PER_LANGUAGE", 5)
    whole, part = (language._sample(rows, dict.fromkeys(SYLLABLES, share)) for share in (1.0, 0.5))
    assert len(whole) == 25 and whole.to_pylist() == part.to_pylist()
    same_id = language.learn(documents.withColumn("doc_id", F.lit(3)))
    assert set(same_id.within["romance"].names) == {"es", "fr"}
    assert language.learn(documents)("der und ein sch ung keit")[0] == "de"


def test_long_texts_are_read_whole():
    text = "a" * 10 + " the" * 600_000 + " schkeitung" * 600_000
    import numpy as np

    whole = language.features(text)
    step = language.STEP
    try:
        language.STEP = 1 << 30
        assert np.allclose(whole, language.features(text))
    finally:
        language.STEP = step
