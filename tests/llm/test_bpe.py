import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm import bpe, registry
from tests.llm.conftest import ODD

PATH = registry.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def same(codec, text):
    ids = list(codec.encode(text))
    assert ids == ids_of(text)
    assert codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abehinort' THΣß1²é!?.,-_\n\t\x1c\x85  İ漢🙂é")), max_size=60))
def test_equals_the_library(text):
    same(bpe.codec(PATH), text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|> b<|endoftext", "it's we'll 'sabc", "퟿​", "OSΣ Σ", "ﬁ ½ Ⅷ １", "a\u0558b \ua7cba\U000323b0漢1\u1c89!"])
def test_odd_texts(codec, text):
    same(codec, text)


@pytest.mark.parametrize("letters", ["a", "ha", "th", "ing", "!", "0", "é", "漢字"])
def test_pre_tokens_longer_than_the_window(codec, letters):
    assert codec.merges.window < 3000
    same(codec, letters * 5000)


def test_random_long_pre_tokens(codec):
    draw = random.Random(1)
    for alphabet in ("ab", "thein", "stionare", "éüßñ"):
        same(codec, "".join(draw.choice(alphabet) for _ in range(8000)))


def test_many_texts_at_once_and_in_slices(codec, monkeypatch):
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("theinaos,.'") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 80))) for _ in range(200)] + [None]
    want = [ids_of(t or "") for t in texts]
    for size, kept, window in ((1 << 23, 10**6, 1 << 13), (64, 50, 16), (1, 1, 1)):
        monkeypatch.setattr(bpe, "TOGETHER", size)
        monkeypatch.setattr(bpe, "WINDOW", window)
        monkeypatch.setattr(bpe, "RECENT", kept)
        got = [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in codec.encode_all(texts)]
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abehinort' THΣß1é!?.,-\n\t\u0301<|endoftext|>")), max_size=200), st.integers(1, 40))
def test_windows_of_any_size(text, window):
    """What windows emit, one after the other, is what the whole text gives; decoding in small chunks too."""
    codec, own = bpe.codec(PATH), (bpe.WINDOW, bpe.IDS)
    try:
        bpe.WINDOW, bpe.IDS = window, 1 + window % 3
        ids = [i for part in codec.stream(text) for i in part.tolist()]
        assert ids == ids_of(text) and codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    finally:
        bpe.WINDOW, bpe.IDS = own


def test_a_stream_needs_one_window(codec):
    """Memory of a stream is that of a window, not of the text; so is what decoding holds."""
    import tracemalloc

    peaks = []
    for words in (20_000, 400_000):
        text = "the rain in spain falls mainly on the plain, " * (words // 9)
        for part in codec.stream(text[:20_000]):
            pass
        tracemalloc.start()
        for part in codec.stream(text):
            pass
        for part in codec.decoded(i % 49_000 for i in range(words)):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + (1 << 20)


def test_byte_level_vocabulary_round_trip():
    codec = bpe.BpeCodec(registry.vocabulary("byte_bpe_50k.json"))
    library = Tokenizer.from_file(registry.vocabulary("byte_bpe_50k.json"))
    for text in ("Hello  world\n\n x", "naïve 漢字 🙂", " lead", "a" * 3000, "tabs\t\tand 123 456's"):
        ids = list(codec.encode(text))
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


def test_decoder_holds_only_what_is_incomplete():
    machine = bpe.ByteText()
    data = "é漢🙂".encode()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.end() == "é漢🙂"
    assert machine.feed("漢".encode()[:2]) == "" and machine.end() == "�"


def test_lookahead_suffices_for_a_small_list():
    """Every window that is long enough gives the tokens of the whole word."""
    merges = [("a", "b"), ("b", "a"), ("ab", "ab"), ("ba", "b"), ("a", "a"), ("abab", "a")]
    vocabulary = {c: i for i, c in enumerate(dict.fromkeys([*bpe.byte_alphabet(), *(a + b for a, b in merges)]))}
    table = bpe.MergeList(vocabulary, merges, "")
    name = {i: t for t, i in vocabulary.items()}

    def plain(word):
        parts = list(word)
        rank = {p: r for r, p in enumerate(merges)}
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    import numpy as np

    draw = random.Random(3)
    for _ in range(200):
        word = "".join(draw.choice("ab") for _ in range(draw.randint(1, 400)))
        got = [name[i] for part in table.stream(np.frombuffer(word.encode(), np.uint8)) for i in part.tolist()]
        assert got == plain(word)


def test_a_list_out_of_order_is_refused():
    vocabulary = {c: i for i, c in enumerate([*bpe.byte_alphabet(), "ab", "abc"])}
    with pytest.raises(ValueError):
        bpe.MergeList(vocabulary, [("ab", "c"), ("a", "b")], "")


def test_query(spark, odd, nothing, tables):
    rows = registry.op1_bpe(spark, tables(documents=odd)).collect()
    assert len(rows) == len(ODD)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(d), len(i := ids_of(t or "")), digest(" ".join(map(str, i))), digest(LIBRARY.decode(i, skip_special_tokens=False))) for d, t in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert registry.op1_bpe(spark, tables(documents=nothing)).count() == 0
    assert spark.range(1).selectExpr("cast(null as array<int>) ids").select(bpe.token_text(__import__("pyspark").sql.functions.col("ids"), PATH).alias("t")).first().t is None
