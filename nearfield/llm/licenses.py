"""Licence scans by Dice coefficients over word bigrams, in DataFrame functions only.

A text is normalised (lower case, letters and digits only, so line breaks and comment signs are nothing)
and read as a list of word bigrams. A *window* of it and a template are compared as bags of bigrams:
``2 * common / (window's + template's)``. A coefficient of ``least`` needs sizes within a factor
of ``(2 - least) / least`` of each other, so a template of n bigrams has windows of at most ``high``
bigrams with ``fewest`` of the template's in them. A window starts and ends with a bigram of the template; of
those that start at a bigram there are two, the longest of at most n and of at most ``high``. Of a template's windows
the one with the best share of its bigrams is compared (then the first, then the shorter). A window must also
hold a bigram that tells the template from each similar one (Dice of ``ALIKE``) of another name, such as a version.

Pruning is exact: a template has fewer than ``fewest`` bigrams without any of some few key words, so a text
that contains none of those words is not even split; and only starts that ``fewest`` bigrams of the
template follow within ``high`` are looked at.

All is done within the row, without a shuffle: the templates are literals, and their size is
checked (at most ``MOST_TEMPLATES`` templates and ``MOST_CHARS`` characters).

Defined cases: a null or empty text, or one without a match, has a null licence, coefficient 0
and no matches; of equal coefficients the first template by name wins, then the earlier window;
repeated rows are scanned each; an empty table gives an empty one; columns other than the two
named are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.notices import TEMPLATES

LEAST, ALIKE = 0.8, 0.5
MOST_TEMPLATES, MOST_CHARS = 500, 2_000_000
#: Letters of a key word, if a template has such words.
KEY_LETTERS = 6


def bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def dice(a: Counter, b: Counter) -> float:
    return 2.0 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


@dataclass
class Template:
    name: str
    grams: Counter
    size: int
    #: Bigrams of the template that a match needs at least, and bigrams of a window at most.
    fewest: int
    high: int
    #: A window needs one of each of these sets.
    told_by: list[list[str]]


def prepared(templates: list[tuple[str, str]], least: float) -> list[Template]:
    out = []
    for name, text in sorted(templates):
        grams = Counter(bigrams(text))
        if not grams:
            raise ValueError(f"the template {name!r} has fewer than two words")
        size = sum(grams.values())
        out.append(Template(name, grams, size, math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9), []))
    for t in out:
        for u in out:
            if u.name != t.name and dice(t.grams, u.grams) >= ALIKE and (own := sorted(set(t.grams) - set(u.grams))):
                t.told_by.append(own)
    return out


def key_words(templates: list[Template]) -> list[str]:
    """Words of which every match has one: without them fewer of a template's bigrams are left than a match needs."""
    chosen: list[str] = []

    def left(t: Template) -> Counter:
        return Counter({g: n for g, n in t.grams.items() if not set(g.split()) & set(chosen)})

    while open_ := [rest for t in templates if sum((rest := left(t)).values()) >= t.fewest]:
        weights: Counter = Counter()
        for rest in open_:
            for gram, n in rest.items():
                for word in set(gram.split()):
                    weights[word] += n
        chosen.append(max(weights, key=lambda w: (len(w) >= KEY_LETTERS, weights[w], len(w), w)))
    return [w for w in chosen if not any(v in w for v in chosen if v != w)]  # a text with "licensed" has "license" too


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, license, dice, n_matches, and matches (name, dice, start, length), best first, at most one of each template.

    ``start`` and ``length`` count bigrams of the text; a window has one word more.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES or sum(len(t) for _, t in templates) > MOST_CHARS:
        raise ValueError("too many templates for literals")
    if not templates:
        return documents.select(F.col(key), F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_matches"), F.array().cast("array<struct<name:string,dice:double,start:int,length:int>>").alias("matches"))
    own = prepared(templates, least)
    none = F.array().cast("array<string>")
    rows = documents.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    maybe = reduce(Column.__or__, [F.contains("text", F.lit(w)) for w in key_words(own)])
    rows = rows.select("key", F.when(maybe, F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")).otherwise(none).alias("words"))
    count = F.size("words") - 1
    rows = rows.select("key", F.when(count > 0, F.zip_with(F.slice("words", F.lit(1), count), F.slice("words", F.lit(2), count), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none).alias("grams"))
    every = {g for t in own for g in t.grams}
    rows = rows.withColumn("hits", F.expr(f"filter(transform(grams, (g, i) -> struct(i as at, g as gram)), h -> h.gram in ({_listed(every)}))"))
    rows = rows.select("key", "grams", *(_places(t).alias(f"at_{n}") for n, t in enumerate(own)))
    rows = rows.select("key", "grams", *(_window(t, f"at_{n}").alias(f"window_{n}") for n, t in enumerate(own)))
    compared = F.array(*(_compared(t, f"window_{n}", least) for n, t in enumerate(own)))
    found = F.filter(compared, lambda m: m.isNotNull() & m.told & (m.minus <= -least + 1e-12))
    rows = rows.select("key", F.sort_array(F.transform(found, lambda m: m.dropFields("told"))).alias("found"))
    first = F.get("found", F.lit(0))
    matches = F.transform("found", lambda m: F.struct(m["name"].alias("name"), (-m.minus).alias("dice"), m.start.alias("start"), m.length.alias("length")))
    return rows.select(F.col("key").alias(key), first["name"].alias("license"), F.coalesce(-first["minus"], F.lit(0.0)).alias("dice"), F.size("found").cast("long").alias("n_matches"), matches.alias("matches"))


def _listed(grams: Iterable[str]) -> str:
    """Bigrams (letters, digits and a space) as SQL literals, which Spark looks up by hash."""
    return ", ".join(f"'{g}'" for g in sorted(grams))


def _constant(value: object, kind: str) -> str:
    """A literal of any size that is two nodes of the plan until it is folded."""
    return f"from_json('{json.dumps(value, ensure_ascii=False)}', '{kind}')"


def _let(name: str, value: str, use: str) -> str:
    """``use`` with a value that is computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _places(t: Template) -> Column:
    """Where a text has bigrams of the template, in ascending order."""
    return F.expr(f"transform(filter(hits, h -> h.gram in ({_listed(t.grams)})), h -> h.at)")


def _window(t: Template, at: str) -> Column:
    """Of the places of a template's bigrams in a text the best window: (minus, start, length), or null."""
    starts = f"filter(transform({at}, (p, i) -> struct(p as p, i as i)), s -> get({at}, s.i + {t.fewest - 1}) - s.p < {t.high})"

    def ending(most: int) -> str:
        inside, length = f"filter(slice({at}, s.i + 1, {most}), x -> x < s.p + {most})", "(array_max(w) - s.p + 1)"
        return _let("w", inside, f"struct(-2.0D * size(w) / ({length} + {t.size}) as minus, s.p as start, {length} as length)")

    return F.expr(f"array_min(transform({starts}, s -> least({ending(t.size)}, {ending(t.high)})))")


def _compared(t: Template, window: str, least: float) -> Column:
    """(minus, name, start, length, told) of the bags of bigrams, or null if they can't be near enough."""
    counts = _constant([{"gram": g, "n": n} for g, n in sorted(t.grams.items())], "array<struct<gram:string,n:int>>")
    common = f"aggregate({counts}, 0, (n, c) -> n + least(c.n, size(w) - size(array_remove(w, c.gram))))"
    told = f"forall({_constant(t.told_by, 'array<array<string>>')}, own -> arrays_overlap(w, own))"
    name = t.name.replace("\\", "\\\\").replace("'", "\\'")
    match = f"struct(-(2.0D * {common} / ({window}.length + {t.size})) as minus, '{name}' as name, {window}.start as start, {window}.length as length, {told} as told)"
    return F.expr(f"if({window}.minus <= {1e-12 - least!r}D, {_let('w', f'slice(grams, {window}.start + 1, {window}.length)', match)}, null)")
