import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import packing, registry
from tests.llm.conftest import ODD
from tests.llm.test_bpe import ids_of


def first_fit(sizes, length):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, used in enumerate(bins) if used + sizes[i] <= length), None)
        if at is None:
            bins.append(0)
            at = len(bins) - 1
        out[i] = (at, bins[at])
        bins[at] += sizes[i]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit_decreasing(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, 100) for _ in range(draw.randint(1, 300))]
    assert list(zip(*packing.first_fit_decreasing(sizes, 100))) == first_fit(sizes, 100)


def test_too_large_a_piece():
    with pytest.raises(ValueError):
        packing.FirstFit(4, 10).place(11)


def check(rows, documents, length):
    """All ids of all documents, once each, in gapless sequences."""
    want = sorted(((d, len(ids_of(t or "")) + 1) for d, t in documents), key=str)
    ids = {t: [*ids_of(t or ""), 2] for _, t in documents}
    assert sorted(((r.doc_id, r.length) for r in rows if r.start == 0 and r.length == r.doc_tokens), key=str) == [w for w in want if w[1] <= length]
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    by = {d: ids[t] for d, t in documents}
    for r in rows:
        part = np.array(by[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert 0 < r.length <= length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(by[r.doc_id])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= length and own[0].padded_length == (end if end & (end - 1) == 0 else length)
    return sequences


def test_query(spark, odd, nothing, tables):
    rows = registry.op5_packing(spark, tables(documents=odd)).collect()
    check(rows, ODD, packing.LENGTH)
    assert registry.op5_packing(spark, tables(documents=nothing)).count() == 0


def test_little_padding_in_groups(spark):
    draw = random.Random(7)
    documents = [(i, " ".join(draw.choice(["the", "and", "of"]) for _ in range(draw.randint(1, 90)))) for i in range(600)]
    frame = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(4)
    rows = packing.pack(packing.pieces(frame, registry.vocabulary(), length=64), 600, length=64, group=200).collect()
    sequences = check(rows, documents, 64)
    assert sum(r.length for r in rows) / (64 * len(sequences)) > 0.95
    assert len({s >> 32 for s in sequences}) == 3


def test_the_same_however_often_it_is_run(spark, odd):
    cut = packing.pieces(odd.coalesce(1).select("doc_id", F.col("text")), registry.vocabulary())
    runs = [sorted(map(str, packing.pack(cut, 9).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
