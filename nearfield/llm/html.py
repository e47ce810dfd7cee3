"""Main text of web pages: site templates are found by counting element subtrees per host.

Each page is parsed, and every element's subtree is hashed bottom-up from its children's digests, in
time linear in the page. A block element has up to two digests: of its *content* (tags, classes and text)
and, where it stands beside the page's article or most of its text is links, of its *shape* (tags
and classes without text, runs of equal children taken as one), since a menu, an advert or a footer is the
same element with other words on each page. Spark counts, for each host, the different articles in whose
pages a digest occurs (copies of one article count once). What occurs in a share of the host's
different articles (``SHARE``; ``WIDE_SHARE`` for shapes and within a marked article), and in
``LEAST_PAGES`` at least, is the site's template: a second parse deletes those subtrees.

Counts can't tell on hosts with too few articles, and a thing that only one page has is no template. So
of what is left, elements whose tag, role or class says menu, header, footer, sidebar, notice, advert, form,
comments and so on go too, and then what stands outside the article, if the article holds half of what
remains. Paragraphs and headings are never counted: prose may repeat.

Only digests are shuffled (a host is its 64-bit hash); templates go to every executor if they are at most
``BROADCAST_TEMPLATES`` (16 bytes each), else pages are joined with them by host. A host has at most
``1 / SHARE`` times as many templates as digests on an average page, whatever its size.

Defined cases: null html is empty and gives an empty text; a null or odd url has an empty host;
repeated rows are extracted each (and count once); broken markup is closed as browsers do;
an empty table gives an empty one; columns other than the three named are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.shared import settled
from nearfield.llm.urls import host_and_path

#: The share of a host's different articles with the same subtree that makes it a template, the
#: same for shapes and within a marked article, and the fewest articles by which that can be told.
SHARE, WIDE_SHARE, LEAST_PAGES = 0.1, 0.5, 4
#: Most templates that are sent to every executor.
BROADCAST_TEMPLATES = 200_000

# HTML element names by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Blocks that are never counted: prose may repeat, and pages consist of these.
UNCOUNTED = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote caption figcaption li dd dt tr td th tbody thead tfoot html body article main".split())
NOT_TEXT = frozenset("head nav aside footer form button select input dialog menu object canvas svg math audio video map search".split()) | RAW
NOT_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager paginate pagination popup "
    "promo promoted promotion related recommended respond share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: Words that leave a name's meaning as it is: parts, places and kinds.
NEUTRAL_WORDS = frozenset(
    "a and area bar block body bottom box bottombar button buttons center col column container content count default desktop form fixed global group header icon icons id inner item items "
    "item lang large left level link links list lower main media mobile module nr of page panel part policy posts primary right row secondary section site slot small sticky sub text thread title "
    "top topbar unit upper wrap wrapper wide x0 x1 1 2 3 4 5 6 7 8 9 0".split()
)
NOT_TEXT_CLASSES = frozenset("header site-header page-header top-header".split())
#: What an element's start closes: of these, up to the nearest of the bounds.
CLOSES = {"li": (frozenset({"li"}), frozenset("ul ol menu dir".split())), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "option": (frozenset({"option"}), frozenset({"select"}))}
CLOSES |= {"tr": (frozenset("tr td th".split()), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"}))}
PARAGRAPH_BOUNDS = frozenset("table td th caption button object template html body".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD_EDGE = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")


MASK, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15
CONTENT, WITHIN, SHAPE = 0, 1, 2  # the two lowest bits of a digest


def _joined(digest: int, child: int) -> int:
    digest = ((digest ^ child) * MIX) & MASK
    return digest ^ (digest >> 29)


def _word(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


@lru_cache(maxsize=1 << 14)
def _opened(tag: str, words: tuple[str, ...]) -> int:
    return _word(f"<{tag} {' '.join(words)}>")


def _kind(digest: int, kind: int) -> int:
    digest = (digest & ~3 | kind) & MASK
    return digest - (1 << 64) if digest >> 63 else digest


class Element:
    """An open element, and afterwards what is known of its subtree."""

    __slots__ = ("tag", "parent", "named", "article", "content", "shape", "last", "chars", "links", "holds", "words")

    def __init__(self, tag: str, parent: Element | None, words: tuple[str, ...]):
        self.tag, self.parent, self.words = tag, parent, words
        self.named, self.article = (parent.named, parent.article) if parent else (False, 0)  # article: 2 in one, 1 in a main element
        self.content = self.shape = _opened(tag, words)
        self.last = 0  # the last child's shape
        self.chars = self.links = 0  # characters of text, and of text in links
        self.holds = False  # an article or main element

    def add(self, content: int, shape: int) -> None:
        self.content = _joined(self.content, content)
        if shape != self.last:
            self.shape, self.last = _joined(self.shape, shape), shape


class Parser:
    """One page: its blocks as (text, innermost element), and all its elements, parents first."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, Element | None]] = []
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of open elements by tag
        self.block_places: list[int] = []
        self.run: list[str] = []
        self.words = ""  # of the run's last text
        self.apart: list[tuple[str, Element]] = []  # text in elements that go by their name
        self.links = 0  # open links

    def parse(self, page: str) -> None:
        at, size = 0, len(page)
        match = TOKEN.match
        while at < size:
            token = match(page, at)
            at = token.end()
            text = token[7]
            if text is not None:
                self.text(text)
                continue
            tag = token[2] or token[5]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1] or token[4]:
                self.end(tag)
                continue
            self.start(tag, token[3] or token[6] or "")
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                self.pop(len(self.open) - 1)
                at = close.end() if close else size
        self.pop(0)
        self.flush()

    def text(self, text: str) -> None:
        own = self.open[-1] if self.open else None
        if text.isspace():
            words = ""
        else:
            words = " ".join((entities.unescape(text) if "&" in text else text).split())
        if own is not None and own.named:
            self.apart.append((words, own))
        else:
            self.run.append(text)
            self.words = words
        if own is not None and words:
            own.add(_word(words), 1)
            own.chars += len(words)
            if self.links:
                own.links += len(words)

    def flush(self) -> None:
        if self.run:
            text = self.words if len(self.run) == 1 else " ".join(entities.unescape("".join(self.run)).split())
            self.run.clear()
            if text:
                self.blocks.append((text, self.open[-1] if self.open else None))
        if self.apart:
            for text, own in self.apart:
                self.blocks.append((text, own))
            self.apart.clear()

    def place(self, tags: Iterable[str]) -> int:
        """The innermost open element of some tags, or -1."""
        found = -1
        for tag in tags:
            if (own := self.places.get(tag)) and own[-1] > found:
                found = own[-1]
        return found

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.run.append(" ")
                self.words = ""
            elif tag in BLOCK:
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            paragraphs = self.places.get("p")
            if paragraphs and paragraphs[-1] > self.place(PARAGRAPH_BOUNDS):  # a block ends an open paragraph
                self.pop(paragraphs[-1])
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            bound = self.place(bounds)
            while (found := self.place(ends)) > bound:
                self.pop(found)
        above = self.open[-1] if self.open else None
        words, role = self.described(attributes) if attributes else ((), "")
        element = Element(tag, above, words)
        element.named = element.named or self.not_text(tag, element.article, words, role)
        if tag == "article" or "articlebody" in map(str.lower, words):
            element.article, element.holds = 2, True
        elif tag == "main" or role == "main":
            element.article, element.holds = max(element.article, 1), True
        if tag == "a":
            self.links += 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.block_places.append(len(self.open))
        self.open.append(element)
        self.elements.append(element)

    @staticmethod
    def described(attributes: str) -> tuple[tuple[str, ...], str]:
        """The words of an element's class, id and item property, and its role."""
        words, role = [], ""
        for name, *values in ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "")
            name = name.lower()
            if name == "role":
                role = value.strip().lower()
            elif name in ("hidden", "aria-hidden"):
                if name == "hidden" or value.lower() == "true":
                    words.append("\x00hidden")
            else:
                words.extend(value.split())
        return tuple(words), role

    @staticmethod
    def not_text(tag: str, article: int, words: tuple[str, ...], role: str) -> bool:
        if tag in NOT_TEXT or role in NOT_TEXT_ROLES or (tag == "header" and not article):
            return True
        if tag in ("html", "body", "main"):
            return False
        for word in words:
            if word == "\x00hidden" or word.lower() in NOT_TEXT_CLASSES:
                return True
            parts = [p.lower() for p in WORD_EDGE.split(word) if p]
            if any(p in NOT_TEXT_WORDS for p in parts) and all(p in NOT_TEXT_WORDS or p in NEUTRAL_WORDS for p in parts):
                return True
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        found = self.place((tag,))
        if found < 0 or (tag not in BLOCK and self.block_places and self.block_places[-1] > found):
            return
        if tag in BLOCK:
            self.flush()
        self.pop(found)

    def pop(self, least: int) -> None:
        while len(self.open) > least:
            element = self.open[-1]
            if element.tag in BLOCK:
                self.flush()
                self.block_places.pop()
            self.open.pop()
            self.places[element.tag].pop()
            if element.tag == "a":
                self.links -= 1
            if element.parent is not None:
                above = element.parent
                above.add(element.content, element.shape)
                above.chars += element.chars
                above.links += element.links
                above.holds |= element.holds

    def counted(self) -> list[tuple[Element, list[int]]]:
        """The elements that may be a template, each with its digests."""
        every = sum(len(t) for t, e in self.blocks if e is None or not e.named)
        inside = sum(len(t) for t, e in self.blocks if e is not None and e.article and not e.named)
        marked = 2 * inside >= every > 0  # the page marks where its text is
        found = []
        for e in self.elements:
            if e.tag in BLOCK and e.tag not in UNCOUNTED and e.chars:
                digests = [_kind(e.content, WITHIN if e.article else CONTENT)]
                if not e.article and not e.holds and (marked or 2 * e.links >= e.chars):
                    digests.append(_kind(e.shape, SHAPE))
                found.append((e, digests))
        return found

    def body(self) -> int:
        """Digest by which copies of an article are told: of the text of the article level that has most."""
        texts = {level: "\n".join(t for t, e in self.blocks if (e.article if e else 0) == level and not (e and e.named)) for level in (2, 1, 0)}
        return _kind(_word(max(texts.values(), key=len)), 0)

    def kept(self, templates: frozenset[int] = frozenset()) -> list[str]:
        """The blocks of the page's text: what neither the counts nor the names delete, of the article if that holds half of it."""
        gone = {id(e) for e, digests in self.counted() if not templates.isdisjoint(digests)} if templates else set()
        if gone:
            for e in self.elements:  # parents first
                if id(e.parent) in gone:
                    gone.add(id(e))
        left = [(t, e) for t, e in self.blocks if id(e) not in gone]
        left = [(t, e.article if e else 0) for t, e in left if e is None or not e.named]
        for level in (2, 1):
            size = sum(len(t) for t, own in left if own >= level)
            if size and 2 * size >= sum(len(t) for t, _ in left):
                return [t for t, own in left if own >= level]
        return [t for t, _ in left]


def read(page: str | None) -> Parser:
    parser = Parser()
    parser.parse(page or "")
    return parser


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            rows = [(own.body(), sorted({d for _, digests in own.counted() for d in digests})) for own in (read(page.as_py()) for page in part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b for b, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.list_(pa.int64()))], names=["host", "body", "digests"])


def _texts(pages: Iterable[str | None], templates: Iterable[frozenset[int]]) -> list[str]:
    return [" ".join(read(page).kept(own)) for page, own in zip(pages, templates)]


def templates_of(hosts: DataFrame) -> DataFrame:
    """[host, digest] of what recurs, from [host, body, digests] of each page."""
    counts = hosts.select("host", F.explode("digests").alias("digest"), "body").distinct().groupBy("host", "digest").agg(F.count(F.lit(1)).alias("articles"))
    articles = hosts.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_articles"))
    share = F.when(F.col("digest").bitwiseAND(F.lit(3)) == CONTENT, SHARE).otherwise(WIDE_SHARE)
    recurring = counts.filter(F.col("articles") >= LEAST_PAGES).join(articles, "host")
    return recurring.filter(F.col("articles") >= share * F.col("all_articles")).select("host", "digest")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast: int = BROADCAST_TEMPLATES) -> DataFrame:
    """One row per page: key, url, text."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.xxhash64(host_and_path(F.col(url))[0]).alias("host"), F.col(html).alias("html"))
    found = templates_of(rows.select("host", "html").mapInArrow(_count, "host bigint, body bigint, digests array<bigint>"))
    found = settled(found.coalesce(pages.sparkSession.sparkContext.defaultParallelism))  # a file a core, not a shuffle partition: each costs processes
    if found.count() <= broadcast:
        table = found.toArrow()
        by_host: dict[int, set[int]] = {}
        for host, digest in zip(table["host"].to_pylist(), table["digest"].to_pylist()):  # at most ``broadcast`` rows
            by_host.setdefault(host, set()).add(digest)
        sent = pages.sparkSession.sparkContext.broadcast({host: frozenset(own) for host, own in by_host.items()})
        none: frozenset[int] = frozenset()
        text = F.arrow_udf(lambda hosts, html: pa.array(_texts((h.as_py() for h in html), (sent.value.get(h, none) for h in hosts.to_pylist())), pa.string()), "string")("host", "html")
    else:
        rows = rows.join(found.groupBy("host").agg(F.collect_list("digest").alias("templates")), "host", "left")
        text = F.arrow_udf(lambda html, own: pa.array(_texts((h.as_py() for h in html), (frozenset(t.as_py() or ()) for t in own)), pa.string()), "string")("html", "templates")
    return rows.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"))
