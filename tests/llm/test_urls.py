import pytest
from pyspark.sql import functions as F

from nearfield.llm import registry, urls

URLS = [
    None, "", "no scheme", "http://", "://x.com/", "https://example.com/en/a?q#f", "https://WWW.Example.COM/en/", "http://www.example.com/de/", "http://a.www.example.com/en/x", "http://example.com/en", "http://notexample.com/en/",
    "ftp://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://x.net:80/es/", "http://user@x.com/", "http://x.com", "http://x.com?u=http://y.net/fr/", "http://x.com#/en/", "http://x.net//es/", "http://ÄX.com/é/", "x://y://z.com/",
    "http://" + "a." * 120 + "com/" + "p/" * 5000, "http://.com/", "http://com./",
]


def brute(url, rules=registry.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, None), (5, URLS[5])]
    return spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("row", F.lit(1)).withColumn("short", F.lit(1)).repartition(3)


def test_contract(spark, pages, tables):
    rows = registry.op9_urls(spark, tables(pages=pages)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id])
    assert registry.op9_urls(spark, tables(pages=pages.limit(0))).count() == 0


@pytest.mark.parametrize("most", [0, 50_000])
def test_any_rules_with_and_without_broadcast(spark, pages, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rules = [("com", "", "block"), ("example.com", "/e", "block"), ("example.com", "/e", "allow"), ("www.example.com", "", "allow"), ("x.net", "/es/1", "block"), ("net", "/", "allow")]
    frame = spark.createDataFrame([*rules, ("x", None, "block"), (None, "/", "block"), ("com", "", "block")], "host string, path string, verdict string")
    for r in urls.judge(pages, frame).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id], rules)


def test_no_rules(spark, pages):
    frame = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in urls.judge(pages, frame, default="block").collect()} == {(None, "block")}


def test_short_prefixes_are_confirmed(spark, pages, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 1)
    for r in urls.judge(pages, spark.createDataFrame(registry.RULES, "host string, path string, verdict string")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id])


def test_the_join_is_on_short_prefixes(spark, pages):
    plan = urls.judge(pages, spark.createDataFrame(registry.RULES, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin [short" in plan and "rule_digest" not in plan.split("HashJoin [short")[1].split("]")[0] and "digest" not in plan.split("HashJoin [short")[1].split("]")[0]


def test_very_long_hosts(spark):
    """A megabyte of labels is no more than its last few."""
    rows = [(1, "http://" + "a." * 500_000 + "example.com/en/x"), (2, "http://" + "." * 500_000 + "net/fr/")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, spark.createDataFrame(registry.RULES, "host string, path string, verdict string")).collect()}
    assert found == {1: ("example.com/en/", "block"), 2: ("net/fr/", "block")}
