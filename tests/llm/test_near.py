import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import components as stars
from nearfield.llm import near, registry
from nearfield.llm.components import components
from tests.llm.conftest import ODD


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def is_similar(a, b):
    n = lcs(a.tolist(), b.tolist())
    return 9 * n >= 4 * (len(a) + len(b))


def brute(rows):
    """Classes as sets of row numbers, from all pairs."""
    marks = [near.kmers(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 0.8 * max(len(marks[i]), len(marks[j])) <= min(len(marks[i]), len(marks[j])) and root(i) != root(j) and is_similar(marks[i], marks[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(i)
    return sorted(out.values())


def family(draw, base, copies, edits):
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(base)]
    out = [" ".join(words)]
    for _ in range(copies):
        own = words[:]
        for _ in range(draw.randint(0, edits)):
            at = draw.randrange(len(own))
            kind = draw.random()
            if kind < 0.5:
                own[at] = f"e{draw.randint(0, 10**6)}"
            elif kind < 0.75:
                del own[at]
            else:
                own.insert(at, f"i{draw.randint(0, 10**6)}")
        out.append(" ".join(own))
    return out


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {}
    for r in near.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        got.setdefault(r.class_id, []).append((r.doc_id, r.class_size, r.kept))
    assert sorted(sorted(d for d, _, _ in own) for own in got.values()) == brute(rows)
    for least, own in got.items():
        assert least == min(d for d, _, _ in own) and {n for _, n, _ in own} == {len(own)} and [d for d, _, k in own if k] == [least]


def test_equals_brute_force(spark):
    draw = random.Random(11)
    texts = [t for _ in range(12) for t in family(draw, draw.randint(20, 120), draw.randint(0, 6), 8)]
    draw.shuffle(texts)
    check(spark, texts)


def test_a_large_group_and_a_shared_passage(spark, monkeypatch):
    """Blocks and the finishing pass: a group whose copies are partly similar, and unlike texts with one passage."""
    monkeypatch.setattr(near, "BLOCK", 8)
    draw = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(draw, 70, 45, 7) + [passage + " " + " ".join(f"x{draw.randint(0, 10**6)}" for _ in range(50)) for _ in range(40)]
    draw.shuffle(texts)
    check(spark, texts)


def test_odd_rows(spark, odd, nothing, tables):
    rows = registry.op10_near(spark, tables(documents=odd)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.class_id, []).append(r)
    assert sorted((str(c), len(own)) for c, own in got.items()) == [("1", 3), ("4", 3), ("6", 1), ("7", 1), ("None", 1)]
    assert all(sum(r.kept for r in own) == 1 for own in got.values()) and len(rows) == len(ODD)
    assert registry.op10_near(spark, tables(documents=nothing)).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    draw = random.Random(13)
    for _ in range(300):
        n = draw.randint(1, 60)
        a = np.array(draw.sample(range(1000), n), dtype=np.uint32)
        b = [x for x in a.tolist() if draw.random() > 0.08]
        for _ in range(draw.randint(0, 5)):
            b.insert(draw.randint(0, len(b)), draw.randint(1000, 2000))
        if draw.random() < 0.3:
            draw.shuffle(b)
        b = np.array(list(dict.fromkeys(b)) or [5000], dtype=np.uint32)
        true = lcs(a.tolist(), b.tolist())
        got = near.alignment(a, b)
        assert got == true if 9 * true >= 4 * (len(a) + len(b)) else got <= true
        assert near.similar(a, b) == (9 * true >= 4 * (len(a) + len(b)))


def test_kmers_are_labelled_by_occurrence():
    assert len(set(near.kmers("a b " * 50).tolist())) == 96
    assert (near.kmers("One, two three-four FIVE six!") == near.kmers("one two threefour five six")).all()
    assert len(near.kmers("four words are here")) == len(near.kmers("")) == len(near.kmers("!!!")) == 1
    assert (near.kmers(None) == near.kmers("")).all() and (near.kmers("!!!") != near.kmers("")).all()


def test_words_in_slices(monkeypatch):
    text = "One two, (three) --- ß É\u2028four\tfive " * 40 + "x" * 500 + " end"
    whole = near.words(text)
    assert len(whole) == 7 * 40 + 2 and len(set(whole.tolist())) == 9
    monkeypatch.setattr(near, "SLICE", 16)
    assert (near.words(text) == whole).all()
    assert len(near.words(" ,; ")) == len(near.words("")) == 0


def test_sketches_in_steps(monkeypatch):
    own = near.kmers(" ".join(f"w{i}" for i in range(700)))
    whole = near.sketch(own)
    monkeypatch.setattr(near, "STEP", 33)
    assert (near.sketch(own) == whole).all()


def test_sketches_follow_the_order():
    words = [f"w{i}" for i in range(400)]
    forward = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])  # nearly the same k-mers in another order
    a, b = near.sketch(near.kmers(forward)), near.sketch(near.kmers(swapped))
    assert (a == b).sum() < near.SKETCHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 200: 0}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def least_of(edges):
    """For each node of the edges that is not its component's least one, that least one."""
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return {n: m for n, m in label.items() if n != m}


def drawn_edges(draw, nodes, count):
    numbers = draw.sample(range(-(10**12), 10**12), nodes)
    return [(draw.choice(numbers), draw.choice(numbers)) for _ in range(count)]


def rounds_of(monkeypatch):
    taken, plain = [], stars._large_star
    monkeypatch.setattr(stars, "_large_star", lambda edges: taken.append(1) or plain(edges))
    return taken


def test_components_of_one_share_take_no_round(spark, monkeypatch):
    """Each round costs the driver ten jobs, at any size of the table."""
    edges, taken = [*((i + 1, i) for i in range(300)), *drawn_edges(random.Random(3), 200, 150)], rounds_of(monkeypatch)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()}
    assert got == least_of(edges) and not taken


def test_components_of_several_shares(spark, monkeypatch):
    monkeypatch.setattr(stars, "SHARE", 64)
    edges, taken = [*((i + 1, i) for i in range(100)), *drawn_edges(random.Random(4), 300, 260)], rounds_of(monkeypatch)
    rows = components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(4)).collect()
    assert {r.u: r.v for r in rows} == least_of(edges) and len(rows) == len(least_of(edges)) and taken


@pytest.mark.parametrize("edges, want", [([(2, 1), (3, 1), (9, 8)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False), ([(2, 1), (2, 1)], True)])
def test_stars_are_told(spark, edges, want):
    assert stars._are_stars(spark.createDataFrame(edges, "u bigint, v bigint")) is want


@pytest.mark.parametrize("share", [4, 16, 1 << 18])
def test_contracted_edges_join_the_same(monkeypatch, share):
    monkeypatch.setattr(stars, "SHARE", share)
    for seed in range(20):
        draw = random.Random(seed)
        edges = [(a, b) for a, b in drawn_edges(draw, 30, draw.randint(1, 40)) if a != b]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges[i : i + 3])], names=["u", "v"]) for i in range(0, len(edges), 3)]
        out = [e for b in stars._contracted(batches) for e in zip(*(c.to_pylist() for c in b.columns))]
        assert least_of(out) == least_of(edges) and all(u > v for u, v in out)
        assert share < 1 << 18 or dict(out) == least_of(edges)


@pytest.mark.parametrize("n", [0, 1, 127])
def test_signatures(n):
    own = near.kmers(" ".join(f"w{i}" for i in range(300)))
    assert near.likely(near.signature(own), np.stack([near.signature(own), near.signature(near.kmers("other text here"))])).tolist() == [0]
    assert (near.signature(own)[n] == 0) == (not (own >> np.uint64(57) == n).any())


def lines_between(draw, paragraphs, line, size):
    """Paragraphs each after the same line, and the same text without the first such line."""
    common = " ".join(f"l{i}" for i in range(line))
    own = [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(size)) for _ in range(paragraphs)]
    return " ".join(f"{common} {p}" for p in own), " ".join([own[0], *(f"{common} {p}" for p in own[1:])])


@pytest.mark.parametrize(("line", "size"), [(12, 40), (20, 60), (20, 40), (30, 50)])
def test_a_repeated_line_that_one_text_lacks(spark, line, size):
    a, b = lines_between(random.Random(14), 30, line, size)
    x, y = ((near.plain(t) >> np.uint64(32)).astype(np.uint32) for t in (a, b))
    assert near.alignment(x, y) == lcs(x.tolist(), y.tolist()) and near.similar(x, y)
    assert len({r.class_id for r in near.classes(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")).collect()}) == 1


@pytest.mark.parametrize("at_once", [1, 7, 1024])
def test_alignment_of_interleaved_repeats(monkeypatch, at_once):
    monkeypatch.setattr(near, "ROWS_AT_ONCE", at_once)
    draw, alike = random.Random(15), 0
    for _ in range(400):
        kinds = draw.choice([2, 5, 20, 60])
        a = [draw.randrange(kinds) for _ in range(draw.randint(1, 90))]
        b = [x for x in a if draw.random() > 0.06]
        for _ in range(draw.randint(0, 6)):
            b.insert(draw.randint(0, len(b)), draw.randrange(kinds + 3))
        b = b or [1]
        true = lcs(a, b)
        got = near.alignment(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32))
        is_alike = 9 * true >= 4 * (len(a) + len(b))
        alike += is_alike
        assert got == true if is_alike else got <= true
        assert near.similar(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)) == is_alike
    assert 50 < alike < 390
