"""BPE encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine.

A merge list fixes how far to the right a token's boundary can depend on the text: its
*sufficient lookahead*. The transducer reads every text in windows of ``WINDOW`` characters. Tokens are
emitted once they are stable: those of a word that ends inside the window (nothing to the right
of a word end can change them), and, of a word that is longer than the window, those that end at least the
lookahead before the end of what has been read. The rest is carried into the next window. So
besides the text itself, which Spark hands over whole, a stream needs one window, whatever the
length of the text or of its words. Streams of many texts run side by side, so that NumPy merges the
words of all their windows at once; words met lately are remembered (``RECENT`` at most).

Decoding takes ids in chunks of ``IDS`` and feeds their bytes to a machine whose only state is
the incomplete UTF-8 sequence at the end.

Defined cases: null text encodes as the empty text; null ids decode to null; ids outside the
vocabulary decode to nothing; repeated rows are encoded each; other columns pass through.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker remembers (some 50 bytes each); then the latest texts' words stay.
RECENT = 400_000
#: Characters of a text's window, characters of all windows that are merged at once, and ids that are decoded at once.
WINDOW, TOGETHER, IDS = 1 << 13, 1 << 21, 1 << 12


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


NO_MERGE = np.int32(2**31 - 1)


@dataclass
class Segments:
    """Lists of ids as parts of one array."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, sizes: np.ndarray) -> Segments:
        return Segments(flat, np.cumsum(sizes) - sizes, sizes)

    @staticmethod
    def empty(count: int) -> Segments:
        return Segments(np.zeros(0, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64))

    @staticmethod
    def joined(parts: list[Segments]) -> Segments:
        before = np.cumsum([0, *(len(p.flat) for p in parts)])
        return Segments(np.concatenate([p.flat for p in parts]), np.concatenate([p.starts + n for p, n in zip(parts, before)]), np.concatenate([p.sizes for p in parts]))

    def take(self, which: np.ndarray) -> Segments:
        """The lists with these numbers, one after the other."""
        sizes = self.sizes[which]
        out = Segments.of(np.zeros(0, np.int32), sizes)
        where = np.repeat(self.starts[which] - out.starts, sizes)
        out.flat = self.flat[where + np.arange(len(where))]
        return out

    def grouped(self, counts: np.ndarray) -> Segments:
        """Neighbouring lists joined: as many as each count says."""
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(self.sizes)])
        return Segments.of(self.flat, total[ends] - total[ends - counts])


class MergeList:
    """A vocabulary with its merges and their sufficient lookahead; works on many words at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffixed = bool(suffix)
        size = max(vocabulary.values()) + 1
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            if any(t not in made and len(t.removesuffix(suffix)) > 1 for t in (a, b)):
                raise ValueError("a merge comes before the merges that make its parts")
            made.setdefault(a + b, r)
        self.lookahead = self._lookahead(merges, suffix)
        #: Bytes of a long pre-token that are tokenised at a time; none of the list's tokens is longer than a tenth.
        self.window = 2 * self.lookahead + 10 * max((len(t) for t in made), default=1)
        left, right, whole = (np.array([vocabulary[t] for t in side], dtype=np.int64) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self._size, self._whole = size, whole.astype(np.int32)
        #: Bytes of each token.
        self.sizes = np.zeros(size, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix))
        keys = left * size + right
        self._ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self._keys = keys[self._ranks]
        symbols = [c + end for end in ("", suffix) for c in byte_alphabet()]
        #: Ids of the 256 bytes within a word, then of the 256 that end one.
        self._base = np.array([vocabulary[c] for c in symbols], dtype=np.int32)
        grid = np.arange(512)
        self._first = self._rank(self._base[grid[:, None]].repeat(512, 1).ravel(), self._base[grid[None, :]].repeat(512, 0).ravel()).reshape(512, 512)

    @staticmethod
    def _lookahead(merges: list[tuple[str, str]], suffix: str) -> int:
        """Characters after a token's end that can still change it.

        Whether a merge takes place is open until its right part is known; that part can be
        taken by an earlier merge further right, whose own right part can be taken by a merge
        earlier still, and so on. The longest such chain, in characters, suffices.
        """
        parts: dict[str, tuple[str, str]] = {}
        reach: dict[str, int] = {}
        for left, right in merges:
            spine, extra = right, reach.get(right, 0)
            while spine in parts:
                spine = parts[spine][1]
                extra = max(extra, reach.get(spine, 0))
            reach[left] = max(reach.get(left, 0), len(right.removesuffix(suffix)) + extra)
            parts.setdefault(left + right, (left, right))
        return max(reach.values(), default=0)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or ``NO_MERGE``; -1 stands for no neighbour."""
        if not len(self._keys):
            return np.full(len(left), NO_MERGE)
        key = left.astype(np.int64) * self._size + right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], NO_MERGE)

    def _merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rows of base symbols (padded by -1): in each the earliest merge, leftmost first, until none is left.

        Gives the rows' ids one after the other, the rows in that order, and their sizes.
        """
        ids = np.where(symbols >= 0, self._base[symbols], np.int32(-1))
        ranks = np.where((symbols[:, :-1] >= 0) & (symbols[:, 1:] >= 0), self._first[symbols[:, :-1], symbols[:, 1:]], NO_MERGE)
        rows = np.arange(len(ids))
        out: list[tuple] = []
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                live = best != NO_MERGE
            else:
                live = np.zeros(len(rows), dtype=bool)
            if not live.all():
                ended = ids[~live]
                out.append((ended[ended >= 0], rows[~live], (ended >= 0).sum(1)))
                if not live.any():
                    break
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
            each, columns = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.where(columns > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[each, at] = new = self._whole[best]
            columns = columns[:-1]
            ranks = np.where(columns > at[:, None], ranks[:, 1:], ranks[:, :-1])
            inner = at > 0
            ranks[each[inner], at[inner] - 1] = self._rank(ids[each[inner], at[inner] - 1], new[inner])
            inner = at < ids.shape[1] - 1
            ranks[each[inner], at[inner]] = self._rank(new[inner], ids[each[inner], at[inner] + 1])
        return tuple(map(np.concatenate, zip(*out)))

    def encode(self, words: pa.StringArray) -> Segments:
        """The ids of each word."""
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        usual = order[sizes[order] <= self.window]
        made, own, start = [], [], 0
        while start < len(usual):
            shortest = int(sizes[usual[start]])
            most = max(1, min(1 << 14, (1 << 18) // shortest))
            stop = start + int(np.searchsorted(sizes[usual[start : start + most]], shortest * 9 // 8 + 1, side="right"))
            block = usual[start:stop]
            columns = np.arange(int(sizes[block[-1]]))
            inside = columns < sizes[block][:, None]
            symbols = np.where(inside, data[np.where(inside, starts[block][:, None] + columns, 0)].astype(np.int16), np.int16(-1))
            if self.suffixed:
                symbols[np.arange(len(block)), sizes[block] - 1] += 256
            ids, rows, counts = self._merge(symbols)
            made.append(Segments.of(ids, counts))
            own.append(block[rows])
            start = stop
        for i in order[len(usual) :].tolist():
            ids = np.concatenate(list(self.stream(data[starts[i] : starts[i] + sizes[i]])))
            made.append(Segments.of(ids, np.array([len(ids)])))
            own.append(np.array([i]))
        out = Segments.empty(len(words))
        if made:
            at = np.concatenate(own)
            joined = Segments.joined(made)
            out.flat = joined.flat
            out.starts[at], out.sizes[at] = joined.starts, joined.sizes
        return out

    def stream(self, word: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of a word (its bytes) of any length: a window's tokens are emitted once they are stable."""
        start = 0
        while len(word) - start > self.window:
            ids = self._merge(word[None, start : start + self.window].astype(np.int16))[0]
            ends = np.cumsum(self.sizes[ids])
            stable = int(np.searchsorted(ends, self.window - self.lookahead, side="right"))
            yield ids[:stable]
            start += int(ends[stable - 1])
        symbols = word[None, start:].astype(np.int16)
        if self.suffixed:
            symbols[0, -1] += 256
        yield self._merge(symbols)[0]


#: White space to ``str.split`` but not to the splitters' ``\\s``.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_LAST_GAP, _GAP = regex.compile(r"(?r)\s"), regex.compile(r"\s")


# The tokenizers library splits by Unicode 16 and lower-cases by Unicode 17, ``regex`` splits by a later
# version, and Python lower-cases by 15.1. Ranges of letters and numbers that the splitters do not count as
# such, and ranges of capital letters with the distance to their small ones.
NOT_COUNTED = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 "
    "18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
LATE_CAPITALS = {"1c89": 1, "a7cb": 0x264 - 0xA7CB, "a7cc": 1, "a7ce": 1, "a7d2": 1, "a7d4": 1, "a7da": 1, "a7dc": 0x19B - 0xA7DC, "10d50-10d65": 0x20, "16ea0-16eb8": 0x1B}


def _range(spec: str) -> range:
    first, _, last = spec.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


LATE = {point: point + by for spec, by in LATE_CAPITALS.items() for point in _range(spec)}


@lru_cache(maxsize=1)
def _odd_points() -> np.ndarray:
    """For each code point whether Unicode versions differ about it."""
    out = np.zeros(0x110000, dtype=bool)
    for spec in NOT_COUNTED.split():
        out[_range(spec)] = True
    out[list(LATE)] = True
    return out


def is_odd(text: str) -> bool:
    return not text.isascii() and bool(_odd_points()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)].any())


class BpeCodec:
    """Encoder and decoder of a tokenizer file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE is supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = MergeList(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._normalise = self._steps(spec.get("normalizer"))
        self._split, self._spaced = self._splitter(spec["pre_tokenizer"])
        points = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in map(_range, NOT_COUNTED.split()))
        self._strict_split = regex.compile(regex.sub(r"\\p\{([LN])\}", lambda m: f"[\\p{{{m[1]}}}--[{points}]]", self._split.pattern), regex.V1)
        self._lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        self._keeps_space = bool(self._split.fullmatch(" ") or self._split.fullmatch(" a"))
        self._byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self._whole_words = not self._spaced and self._split.findall("aßЖ語") == ["aßЖ語"]
        self._recent, self._recent_ids = pa.array([], pa.string()), Segments.empty(0)
        self.surface = self._surface()

    @staticmethod
    def _steps(spec: dict | None) -> list:
        """Text normalisation as a list of functions."""
        if spec is None:
            return []
        kind = spec["type"]
        if kind == "Sequence":
            return [f for part in spec["normalizers"] for f in BpeCodec._steps(part)]
        if kind == "NFC":
            return [lambda t: t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)]
        if kind == "Lowercase":  # of each character alone, so a final sigma is like any other
            return [lambda t: t.replace("Σ", "σ").lower()]
        if kind == "Replace":
            pattern = regex.compile(spec["pattern"].get("Regex") or regex.escape(spec["pattern"]["String"]))
            if pattern.pattern == r"\s+":  # pre-tokens hold no white space, so its kind is irrelevant
                return []
            return [lambda t: pattern.sub(lambda _: spec["content"], t)]
        raise ValueError(f"unknown normaliser {kind}")

    @staticmethod
    def _splitter(spec: dict) -> tuple[regex.Pattern, bool]:
        parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        for part in parts:
            if part["type"] == "Split" and part["invert"] and part["behavior"] == "Removed":
                return regex.compile(part["pattern"]["Regex"]), False
            if part["type"] == "ByteLevel" and part["use_regex"]:
                return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), bool(part["add_prefix_space"])
        raise ValueError("unknown pre-tokeniser")

    def _surface(self) -> list[bytes]:
        """What each id adds to the decoded bytes.

        A file without a decoder joins its tokens by spaces as they are written; a byte-level
        one stands for the bytes themselves.
        """
        size = max(self.vocab, default=-1) + 1
        if not self._byte_decoder:
            return [(self.vocab[i] + " ").encode() if i in self.vocab else b"" for i in range(size)]
        byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        plain = set(self.special.values())
        return [(self.vocab[i].encode() if i in plain else b"".join(byte.get(c, c.encode()) for c in self.vocab[i])) if i in self.vocab else b"" for i in range(size)]

    def _words(self, words: pa.StringArray) -> Segments:
        """The ids of different words; those of recent ones are remembered."""
        at = pc.index_in(words, value_set=self._recent)
        new = words.filter(at.is_null())
        found = self.merges.encode(new)
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self._recent) + np.arange(len(new))
        whole = Segments.joined([self._recent_ids, found])
        if len(self._recent) + len(new) > RECENT:
            self._recent, self._recent_ids = words, whole.take(at)
        else:
            self._recent, self._recent_ids = pa.concat_arrays([self._recent, new]), whole
        return whole.take(at)

    def _cut_words(self, words: pa.StringArray) -> Segments:
        known = words.dictionary_encode()
        return self._words(known.dictionary).take(known.indices.to_numpy())

    def _texts(self, texts: list[str]) -> Segments:
        """The ids of normalised texts whose pre-tokens hold no white space.

        What stands between white space is a chunk: a word if it is all letters, else the
        splitter's words. Each different chunk is looked at once.
        """
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        chunks = lists.flatten().dictionary_encode()
        different = chunks.dictionary
        plain = pc.utf8_is_alpha(different) if self._whole_words else pa.array(np.zeros(len(different), dtype=bool))
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        split = [self._split.findall(c) for c in different.filter(pa.array(~plain)).to_pylist()]
        words = self._cut_words(pa.concat_arrays([different.filter(pa.array(plain)), pa.array(list(chain.from_iterable(split)), pa.string())]))
        counts = np.ones(len(different), dtype=np.int64)
        counts[int(plain.sum()) :] = list(map(len, split))
        own = words.grouped(counts)
        order = np.empty(len(different), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(different))
        return own.take(order[chunks.indices.to_numpy()]).grouped(lists.value_lengths().to_numpy().astype(np.int64))

    def windows(self, text: str) -> Iterator[int | str | list[str]]:
        """A text's stable parts, window by window: ids of special tokens, texts that end where a word does, or lists of words."""
        marked = self._special_split and any(map(text.__contains__, self.special))
        for i, part in enumerate(self._special_split.splititer(text) if marked else [text]):
            if i % 2:
                yield self.special[part]
                continue
            odd = is_odd(part)
            if odd and self._lowers:
                part = part.translate(LATE)
            if self._spaced or self._keeps_space or odd or _SEPARATORS.search(part):
                part = self._normal(part)
                if self._spaced and part and not part[0].isspace():
                    part = " " + part
                found = (self._strict_split if odd else self._split).finditer(part)
                while own := [m[0] for m in islice(found, WINDOW // 8)]:
                    yield own
                continue
            start = 0
            while start < len(part):
                stop = start + WINDOW
                if stop < len(part):
                    # the last word end inside the window or, if a chunk without white space goes beyond it, the chunk's: its words are cut then, and long ones have windows of their own
                    gap = _LAST_GAP.search(part, start, stop) or _GAP.search(part, stop)
                    stop = gap.end() if gap else len(part)
                yield self._normal(part[start:stop])
                start = stop

    def _normal(self, text: str) -> str:
        for step in self._normalise:
            text = step(text)
        return text

    def stream(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of one text as its windows make them stable."""
        for window in self.windows(text or ""):
            yield np.frombuffer(self._resolve([window])[0], dtype="<u4")

    def _resolve(self, pieces: list) -> list[bytes]:
        """The ids of each piece."""
        out = [p.to_bytes(4, "little") if isinstance(p, int) else b"" for p in pieces]
        for kind in (str, list):
            if which := [i for i, p in enumerate(pieces) if isinstance(p, kind)]:
                own = [pieces[i].encode("utf-8", "replace").decode() for i in which] if kind is str else [[w.encode("utf-8", "replace").decode() for w in pieces[i]] for i in which]
                found = self._texts(own) if kind is str else self._cut_words(pa.array(list(chain.from_iterable(own)), pa.string())).grouped(np.array(list(map(len, own))))
                data = found.flat.tobytes()
                for i, start, size in zip(which, found.starts.tolist(), found.sizes.tolist()):
                    out[i] = data[4 * start : 4 * (start + size)]
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers.

        The streams' windows wait until they are ``TOGETHER`` characters; then all that is stable in them is emitted at once.
        """
        done: list[list[bytes]] = []
        waiting: list[tuple[int, int | str | list[str]]] = []
        size = 0

        def emit() -> None:
            for (row, _), ids in zip(waiting, self._resolve([w for _, w in waiting])):
                done[row].append(ids)
            waiting.clear()

        for text in texts:
            done.append([])
            for window in self.windows(text or ""):
                waiting.append((len(done) - 1, window))
                size += 1 if isinstance(window, int) else len(window) * (1 if isinstance(window, str) else 8)
                if size > TOGETHER:
                    emit()
                    size = 0
            if not waiting or len(done) > 1 << 14:
                emit()
                size = 0
                yield from map(b"".join, done)
                done = []
        emit()
        yield from map(b"".join, done)

    def encode_bytes(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode(self, text: str | None) -> array:
        ids = array("I")
        ids.frombytes(self.encode_bytes(text))
        return ids

    def decoded(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of some ids, chunk by chunk, as their bytes make characters whole."""
        machine, ids = ByteText(), iter(ids)
        surface, size = self.surface, len(self.surface)
        while chunk := list(islice(ids, IDS)):
            yield machine.feed(b"".join([surface[i] for i in chunk if 0 <= i < size]))
        yield machine.end()

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(self.decoded(ids))
        return text if self._byte_decoder else text[:-1]


class ByteText:
    """Bytes in, text out: holds only the bytes of a character that is not complete yet."""

    def __init__(self) -> None:
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def end(self) -> str:
        return self._machine.decode(b"", True)


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    """One codec for each file and Python worker."""
    return BpeCodec(path)


def _encode(path: str):
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path)
        values, offsets = [], [0]
        for ids in own.encode_all(t.as_py() for t in texts):
            values.append(ids)
            offsets.append(offsets[-1] + len(ids) // 4)
        flat = np.frombuffer(b"".join(values), dtype="<u4").astype(np.int32, copy=False)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return run


def _decode(path: str):
    def run(ids: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.decode(row.values.to_numpy()) if row.is_valid else None for row in ids], pa.string())

    return run


def token_ids(text: Column, path: str) -> Column:
    """The ids of a text as ``array<int>``."""
    return F.arrow_udf(_encode(path), "array<int>")(text)


def token_text(ids: Column, path: str) -> Column:
    """The text of an array of ids."""
    return F.arrow_udf(_decode(path), "string")(ids)


def encode(documents: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``documents`` with the ids of each text in the column ``to``."""
    return documents.withColumn(to, token_ids(F.col(text), path))


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's ids in the column ``to``."""
    return encoded.withColumn(to, token_text(F.col(ids), path))
