"""URL filters: host-suffix and path-prefix expressions, matched by hash prefix, then by digest.

Each URL becomes the expressions (suffixes of its host at a label boundary, prefixes of its path). Only
suffixes of as many labels, and prefixes of as many characters, as some rule has are made: others equal
no rule, and a host of very many labels or a long path would have their square in expressions. Expressions
and rules meet in an equi-join on the first digits of their SHA-256 alone; full digests then
confirm or refuse what met, and the longest rule that fits decides.

Rules are broadcast only if a count shows at most ``BROADCAST_RULES`` of them (a rule takes
under 3 KB); beyond that both sides are shuffled and adaptive execution splits hot prefixes.

Defined cases: a null URL, or one without ``://``, has an empty host and path; rules with a null
host, path or verdict are ignored; of rules that fit with equal length the one with the longer
host wins, and of the same rule with two verdicts the ``block`` one; repeated rows are judged
each; an empty rule table leaves every URL with the default verdict; columns other than the
two named are not read, so their names can't clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules that are sent to every executor.
BROADCAST_RULES = 50_000
#: Hexadecimal digits of a digest that the join compares.
SHORT = 8
#: The verdict on a URL that no rule fits: lists of this kind name what is treated specially.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after ``://``, up to ``/ ? #``, ASCII letters lower-cased) and path (up to ``? #``)."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: key, host, path, rule (host and path joined, or null) and verdict."""
    rules = rules.select("host", "path", "verdict").dropna().distinct().withColumn("digest", _digest(F.col("host"), F.col("path")))
    rules = rules.select(F.substring("digest", 1, SHORT).alias("short"), F.col("digest").alias("rule_digest"), _labels(F.col("host")).alias("labels"), F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("verdict"), F.concat("host", "path").alias("rule")).alias("found"))
    lengths = rules.select("labels", (F.col("found.size") - F.col("found.host_size")).alias("path")).distinct().collect()  # few: numbers of labels and of characters
    counts, sizes = sorted({r.labels for r in lengths}), sorted({r.path for r in lengths})
    rules = rules.drop("labels")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    host, path = host_and_path(F.col("url"))
    suffixes = F.transform(F.filter(F.array(*map(F.lit, counts)).cast("array<int>"), lambda n: n <= F.col("labels")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    wide = urls.withColumn("labels", _labels(F.col("host"))).withColumn("digest", F.explode_outer(digests)).drop("labels").withColumn("short", F.substring("digest", 1, SHORT))
    met = wide.join(rules, "short", "left").withColumn("found", F.when(F.col("digest") == F.col("rule_digest"), F.col("found")))
    best = met.groupBy("row").agg(F.first("key").alias("key"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("found").alias("found"))
    return best.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
