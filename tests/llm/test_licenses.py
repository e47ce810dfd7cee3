import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.llm import licenses, registry
from tests.llm.conftest import ODD


def brute(text, templates=licenses.TEMPLATES, least=licenses.LEAST):
    """Every window of every start, without any pruning."""
    grams, found, own = licenses.bigrams(text or ""), [], licenses.prepared(templates, least)
    for t in own:
        at = [i for i, g in enumerate(grams) if g in t.grams]
        windows = []
        for p in at:
            for most in (t.size, t.high):
                inside = [x for x in at if p <= x < p + most]
                windows.append((-2.0 * len(inside) / (inside[-1] - p + 1 + t.size), p, inside[-1] - p + 1))
        if windows:
            _, p, size = min(windows)
            window = Counter(grams[p : p + size])
            if licenses.dice(window, t.grams) >= least - 1e-12 and all(any(g in window for g in told) for told in t.told_by):
                found.append((-licenses.dice(window, t.grams), t.name, p, size))
    return [(name, -d, p, size) for d, name, p, size in sorted(found)]


MIT = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
APACHE = max((t for n, t in licenses.TEMPLATES if n == "Apache-2.0"), key=len)
CODE = "\n".join(f"    for i in range({n}): total += values[i] * {n}" for n in range(120))
WRAPPED = "# " + "\n# ".join(textwrap.wrap("Copyright 2020 The Authors. " + MIT, 78)) + "\n" + CODE
TEXTS = [
    "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose about things.", "Licensed under CC BY 4.0.", "released under the mit license", "RELEASED, under the -- MIT License!!",
    "This work is licensed under the GNU General Public License, version 2.\nThis work is licensed under the GNU General Public License, version 3.", MIT, MIT.replace("Software", "Program"),
    "Copyright 2020\n\n" + MIT.replace(". ", ".\n"), "under under under under under the the the the", "Licensed", "", None, "a\nb\n\nc", "released under the mit license " * 2, "word " * 50_000 + "\nReleased under the MIT License.",
    WRAPPED, "/*\n * " + "\n * ".join(textwrap.wrap(APACHE, 70)) + "\n */\n" + CODE, "A tool for all. Released under the MIT License. Some more prose follows here, with many further words about the tool.", "of the software to the license in the software " * 300,
    *(t for _, t in licenses.TEMPLATES),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("templates", F.lit(1)).withColumn("key", F.lit(2)).withColumn("found", F.lit(3))


def test_equals_brute_force(documents):
    for row in licenses.scan(documents).collect():
        want = brute(TEXTS[row.doc_id])
        assert [(m["name"], m.dice, m.start, m.length) for m in row.matches] == want
        assert (row.license, row.dice, row.n_matches) == ((want[0][0], want[0][1], len(want)) if want else (None, 0.0, 0))
        if TEXTS[row.doc_id] in (t for _, t in licenses.TEMPLATES):  # each template is its own best match, and no other version's
            name = next(n for n, t in licenses.TEMPLATES if t == TEXTS[row.doc_id])
            assert (row.license, row.dice) == (name, 1.0)


def test_wrapped_embedded_and_versions(documents):
    rows = {TEXTS[r.doc_id]: r for r in licenses.scan(documents).collect()}
    assert rows[WRAPPED].license == "MIT" and rows[WRAPPED].dice > 0.95
    assert next(r for t, r in rows.items() if t and t.startswith("/*")).license == "Apache-2.0"
    assert next(r for t, r in rows.items() if t and t.startswith("A tool")).license == "MIT"
    assert {m["name"] for m in rows["This work is licensed under the GNU General Public License, version 3."].matches} == {"GPL-3.0"}


def test_pruning_loses_nothing():
    own = licenses.prepared(licenses.TEMPLATES, licenses.LEAST)
    words = licenses.key_words(own)
    for t in own:
        assert sum(n for g, n in t.grams.items() if not any(w in part for part in g.split() for w in words)) < t.fewest
        sizes = [(len_, c) for len_ in range(1, 2 * t.size) for c in range(1, min(len_, t.size) + 1) if 2 * c >= licenses.LEAST * (len_ + t.size) - 1e-9]
        assert min(c for _, c in sizes) == t.fewest and max(len_ for len_, _ in sizes) == t.high


def test_equals_the_sql(spark, documents, tables):
    folder = tables(documents=documents)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got = sorted((r.doc_id, r.license, r.dice, r.n_matches) for r in registry.op7_licenses(spark, folder).collect())
    assert got == sorted(duck.execute(f"select doc_id, license, dice, n_matches from ({registry.OP7_SQL})").fetchall())


def test_own_templates(documents):
    rows = licenses.scan(documents, [("b", "prose about things"), ("a", "more prose about things")], 0.7).collect()
    row = next(r for r in rows if r.doc_id == 0)
    assert (row.license, row.dice, row.n_matches) == ("a", 1.0, 2)
    assert licenses.scan(documents, []).filter("license is not null").count() == 0
    for wrong in ([("x", "one")], [("x", "a b")] * 501):
        with pytest.raises(ValueError):
            licenses.scan(documents, wrong)


def test_native_and_without_a_shuffle(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))


def test_query(spark, odd, nothing, tables):
    assert registry.op7_licenses(spark, tables(documents=odd)).count() == len(ODD)
    assert registry.op7_licenses(spark, tables(documents=nothing)).count() == 0
