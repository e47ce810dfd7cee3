import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from nearfield.llm import html, registry


def text(page):
    return " ".join(html.read(page).kept())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<p>a<b>b</b>c<br>d</p>", "abc d"), ("<ul><li>a<li>b</ul>", "a b"), ("<div>a<div>b</div>c</div>", "a b c"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p>x  \n\t y&nbsp; z</p>", "x y z"), ("<script>var a='<p>no</p>';</script>yes<style>p{}</style>", "yes"), ("<script>never closed <p>x", ""),
        ("<!-- <p>no</p> --><p>yes", "yes"), ("a < b <3 c", "a < b <3 c"), ("<p title='a>b' class=\"x\">in</p>", "in"), ("<p title='open>in</p>", "in"), ("<p>&#233;&eacute;&#x1F642;&am &amp</p>", "éé🙂&am &"),
        ("<header>menu</header><article><header><h1>Title</h1></header><p>body</p><footer>by</footer></article><aside>side</aside><p>outside</p>", "Title body"),
        ("<main><p>m</p><article><p>a</p></article></main>", "a"), ("<main><p>m</p></main><p>o</p>", "m"), ("<div role=main>m</div><div>o</div>", "m"),
        ('<div class="site-nav">n</div><div class="cookie-notice">c</div><div id="comments">r</div><div class="post adBox">a</div><div class="shadow address">kept</div>', "kept"),
        ("<form>f<input></form><button>b</button><nav>n</nav><p hidden>h</p><p aria-hidden='true'>x</p><p>kept</p>", "kept"), ("<article class='comment'>no</article><article>yes</article>", "yes"),
        ("<article><p>one</p><section class='related-posts'><p>no</p></section><p>two</p></article>", "one two"), ("<b><p>a</b>b</p>c", "ab c"), ("</p></div>x", "x"), ("<p>a</p", "a"), ("<p>a<p title='", "a"), ("<", "<"), ("<br/>a<hr>b<img src=x>c", "a bc"),
        ("<textarea>no</textarea><title>no</title>yes", "yes"), ("<P>A</P><DIV CLASS='Ads'>x</DIV>", "A"), ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def page(n, box, body=None):
    body = body or "".join(f"<p>Paragraph {i} of article {n}.</p>" for i in range(3))
    return f"<html><body><article><div><span>{box}</span></div>{body}<p>A passage that repeats.</p></article></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(n, f"https://a.example.com/{n}", page(n, "Follow us everywhere")) for n in range(12)]
    rows += [(100 + n, f"https://b.example.com/{n}", page(n, "Follow us everywhere")) for n in range(3)]
    rows += [(200 + n, "https://c.example.com/x", page(0, "A container of a much copied page")) for n in range(30)]
    rows += [(300, None, None), (301, "nonsense", ""), (302, "https://a.example.com/none", "<p>" + "long " * 100_000), (303, None, "<div>a</div>"), (303, None, "<div>a</div>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2)).withColumn("row", F.lit(3)).repartition(4)


def test_templates_go_where_they_recur(pages):
    rows = {}
    for r in html.extract(pages).collect():
        rows.setdefault(r.page_id, []).append(r.text)
    own = lambda n: " ".join(f"Paragraph {i} of article {n}." for i in range(3)) + " A passage that repeats."
    assert all(rows[n] == [own(n)] for n in range(12))
    assert all(rows[100 + n] == ["Follow us everywhere " + own(n)] for n in range(3))  # three pages are no template
    assert all(rows[200 + n] == ["A container of a much copied page " + own(0)] for n in range(30))  # copies are one article
    assert rows[300] == rows[301] == [""] and rows[302] == [("long " * 100_000).strip()] and rows[303] == ["a", "a"]


def test_query(spark, pages, tables):
    rows = registry.op8_html(spark, tables(pages=pages)).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) for r in rows) and set(rows[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    assert registry.op8_html(spark, tables(pages=pages.limit(0))).count() == 0


def test_templates_are_counted_before_the_rules(spark):
    """A site's recurring article is its template: what is left of the page is its text."""
    teaser = "<article><div>Read our best stories</div></article>"
    rows = [(n, f"https://t.example.com/{n}", f"<nav><ul><li>Home</ul></nav>{teaser}<main><p>The story number {n} is told here.</p></main>") for n in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {n: f"The story number {n} is told here." for n in range(12)}


def digests(page):
    return {d for _, own in html.read(page).counted() for d in own}


def test_all_blocks_are_hashed():
    own = lambda menu, text: f"<nav><ul><li>{menu}</ul></nav><div class='ad'>Buy<br>now</div><article><p>{text}</article><footer>{menu}</footer>"
    text = "A story that is longer than what stands around it"
    first, other, shop = digests(own("Home", text)), digests(own("Home", text + "!")), digests(own("Shop", text))
    assert len(first) == 8 and first == other  # contents and shapes of nav, ul, div, footer
    assert len(first & shop) == 5  # the shapes, and the advert's content
    assert len(digests(own("Home", text).replace("<li>Home", "<li>Home<li>Shop<li>Help")) & first) == 6  # runs of equal children are one


def test_lost_text_is_kept():
    assert text('<div class="social-science"><p>Field notes</p></div>') == "Field notes"
    assert text("<main><p>main text</p><article>teaser</article></main>") == "main text teaser"
    assert text('<div class="content has-sidebar"><p>body</p></div>') == "body" and text('<div itemprop="articleBody">in</div><p>o</p>') == "in"


def test_deep_markup_is_linear(spark):
    deep = "<div>x" * 100_000 + "</b>" * 100_000 + "</div>" * 50_000
    rows = [(n, "https://d.example.com/", deep) for n in range(2)] + [(2, "https://d.example.com/", "<ul><li>" * 50_000), (3, "https://d.example.com/", "<p>" * 100_000 + "end")]
    start = time.time()
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {0: " ".join("x" * 100_000), 1: " ".join("x" * 100_000), 2: "", 3: "end"} and time.time() - start < 60


class Tree(HTMLParser):
    """Plain trees of well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = {"tag": "", "up": None, "in": []}
        self.feed(page)

    def handle_starttag(self, tag, attributes):
        self.at["in"].append({"tag": (tag, tuple(attributes)), "up": self.at, "in": []})
        self.at = self.at["in"][-1]

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["in"].append(data)


def named(tree):
    return (tree["tag"], tuple(t if isinstance(t, str) else named(t) for t in tree["in"]))


def subtrees(tree):
    for t in tree["in"]:
        if not isinstance(t, str):
            yield t
            yield from subtrees(t)


def test_counts_equal_brute_force(spark):
    """Subtrees as nested tuples, counted in plain sets, against digests counted in Spark."""
    draw = random.Random(5)
    rows, trees = [], []
    for n in range(400):
        host = draw.choice("aaab")
        parts = [f"<section><div>{draw.choice('uvwxyz')}</div>{draw.choice(['<p>k</p>', '<div><div>m</div></div>', ''])}</section>" for _ in range(draw.randrange(3))]
        body = f"<div><p>{' '.join(draw.choice(['lorem', 'ipsum', 'dolor', 'sit']) for _ in range(9))} {n // 2}</p></div>"
        draw.shuffle(parts)
        page = "".join([*parts[:1], body, *parts[1:]])
        rows.append((n, f"https://{host}{n // 2 % 2}.example.com/", page))
        trees.append((f"{host}{n // 2 % 2}", Tree(page).root))
    bodies = [html.read(page).body() for _, _, page in rows]
    seen, articles = {}, {}
    for (host, tree), own in zip(trees, bodies):
        articles.setdefault(host, set()).add(own)
        for t in subtrees(tree):
            if t["tag"][0] in ("div", "section"):
                seen.setdefault((host, named(t)), set()).add(own)
    recur = {k for k, v in seen.items() if len(v) >= 4 and len(v) >= 0.1 * len(articles[k[0]])}

    def words(host, tree):
        for t in tree["in"]:
            if isinstance(t, str):
                yield t
            elif (host, named(t)) not in recur:
                yield from words(host, t)

    want = {n: " ".join(words(*tree)) for n, tree in enumerate(trees)}
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for broadcast in (html.BROADCAST_TEMPLATES, 0):
        got = {r.page_id: r.text for r in html.extract(frame, broadcast=broadcast).collect()}
        assert got == want and recur


def test_counts_delete_the_site_parts_of_the_pages(spark):
    """On the given pages menus, adverts and footers go by their counts where a host has enough articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.xxhash64(html.host_and_path(F.col("url"))[0]).alias("host"), "url", "html")
    found = {}
    for r in html.templates_of(pages.select("host", "html").mapInArrow(html._count, "host bigint, body bigint, digests array<bigint>")).collect():
        found.setdefault(r.host, set()).add(r.digest)
    struck = []
    for r in pages.collect():
        for e, own in html.read(r.html).counted():
            if found.get(r.host, set()) & set(own):
                struck.append(e.tag if not e.words else f"{e.tag}.{e.words[0]}")
    counts = Counter(struck)
    assert min(counts["nav"], counts["div.ad"], counts["footer"]) >= 100 and set(counts) <= {"nav", "ul", "div.ad", "footer"}


@pytest.mark.parametrize("scale", [1, 10])
def test_templates_are_a_share_of_the_host(spark, scale):
    """The same parts go and stay whatever the host's size; a passage within articles stays unless most have it."""
    n = 8 * scale
    rows = []
    for i in range(n):
        inner = ("<div>Follow us</div>" if i < n * 3 // 4 else "") + ("<div>A shared passage</div>" if i < n // 4 else "")
        rows.append((i, f"https://in.example.com/{i}", f"<article>{inner}<p>Story {i}</p></article>"))
        rows.append((n + i, f"https://out.example.com/{i}", ("<div>Archive</div>" if i < n // 2 else "") + f"<p>Story {i}</p>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: ("A shared passage " if i < n // 4 else "") + f"Story {i}" for i in range(n)} | {n + i: f"Story {i}" for i in range(n)}


def test_templates_are_written_in_a_file_a_core(spark):
    """However many partitions a shuffle has: each file costs an executor processes of its own."""
    from nearfield.llm import shared

    rows = [(h * 10 + n, f"https://host{h}.org/{n}", page(f"{h}-{n}", f"box of host {h}")) for h in range(40) for n in range(5)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        with shared.recorded() as tables:
            texts = [r.text for r in html.extract(frame).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(tables[0].inputFiles()) <= spark.sparkContext.defaultParallelism and tables[0].count() >= 40
    assert not any("box of host" in t for t in texts) and len(texts) == 200
