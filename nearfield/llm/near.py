"""Near-duplicate classes by order MinHash, with candidates verified by banded alignment.

A text's words (case-folded, letters and digits only) give its k-mers of five words, each
labelled with its occurrence number. A sketch keeps, for each of ``SKETCHES`` hash functions,
the ``LEAST`` minimum labelled k-mers in their text order, so that equal sketches need the
same k-mers in the same order. Texts meet where a sketch is equal. Two texts are near copies
if an order-keeping alignment of their k-mers matches at least 0.8 of all (matches over the
union); a banded alignment of the k-mers without labels decides that exactly, as a similar pair
can't drift further than the band. Classes are the components of these links.

Plan. Texts with the same k-mers are one. Of each group of texts that share a sketch, the
first is compared with the others; pairs are verified once wherever they meet. A group whose other members
are then in one component is done. In the rest, members of different components that meet here first
are candidates unless their binned signatures (the least k-mer of each of ``BINS`` hash ranges)
show that they are not similar. Each text's ``FIRST`` likeliest candidates are verified; groups
where a text has more are then finished exactly: their remaining candidates are
aligned where they meet, likeliest first, but for pairs that links so far have joined. So a large
group of near copies costs few pairs. Groups are dealt out in pairs of blocks of ``BLOCK`` texts: a task's
memory does not grow with the group. What a group has in common (its first text, its size) is a small
table of its own, so that a hot group's rows meet it in a join that adaptive execution can split. Only the
signatures can lose a link: a pair of similarity 0.8 is left out if its share of equal bins is ``SLACK``
standard deviations short, and nothing else joins the two.

Defined cases: a null text is empty; a text of under five words is one k-mer; one without any
word is one k-mer of its characters, so empty texts are copies of each other; repeated rows are
copies; the class id is the least document id (null only if all are); an empty table gives an empty one;
columns other than the two named are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import components
from nearfield.llm.shared import may_be_among, release, settled

WORDS, SIMILAR = 5, 0.8
SKETCHES, LEAST = 16, 2
#: Hash ranges of a signature, and the standard deviations by which a pair's share of equal
#: bins may be short of the similarity.
BINS, SLACK = 128, 4.5
#: Candidates of a text that are verified before its group is finished.
FIRST = 2
#: Texts of a group that a task compares with as many others.
BLOCK = 1024
#: k-mers that are hashed at a time, and characters whose words are.
STEP, SLICE = 1 << 15, 1 << 20
#: Rows of an alignment that share a window of columns.
ROWS_AT_ONCE = 1024
_GAP = re.compile(r"\s")

_draw = np.random.default_rng(20190705)
_FACTORS = _draw.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _draw.integers(0, 2**32, (SKETCHES, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _draw.integers(0, 2**32, (SKETCHES, 1), dtype=np.uint64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """For each code point: 1 if white space, 2 if letter or digit, else 0."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        char = chr(point)
        kinds[point] = 2 if char.isalnum() else char.isspace()
    return kinds


def _hashed(points: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of runs of code points: the first at ``starts``, the last ends at ``length``."""
    sizes = np.diff(np.append(starts, length))
    powers = np.full(int(sizes.max(initial=1)), _FACTORS[0])
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(length) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(_mixed(points.astype(np.uint64) + np.uint64(1)) * powers[place], starts) + sizes.astype(np.uint64))


def words(text: str) -> np.ndarray:
    """Hashes of a text's words: what is between white space, case-folded, less all but letters and digits."""
    kinds, out, start = _characters(), [], 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE) if len(text) - start > SLICE else None
        stop = gap.end() if gap else len(text)
        points = np.frombuffer(text[start:stop].casefold().encode("utf-32-le", "replace"), dtype=np.uint32)
        kind = kinds[points]
        number = np.cumsum(kind == 1)[kind == 2]  # of the white space before each letter or digit
        if len(number):
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            out.append(_hashed(points[kind == 2], starts, len(number)))
        start = stop
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def plain(text: str | None) -> np.ndarray:
    """64-bit hashes of the k-mers of a text, in text order."""
    hashed = words(text or "")
    if not len(hashed):
        points = np.frombuffer(("\x00" + " ".join((text or "").split())).encode("utf-32-le", "replace"), dtype=np.uint32)
        return _hashed(points, np.zeros(1, dtype=np.int64), len(points))
    count = max(1, len(hashed) - WORDS + 1)
    joined = np.zeros(count, dtype=np.uint64)
    for i in range(min(WORDS, len(hashed))):
        joined += _mixed(hashed[i : i + count] + np.uint64(i)) * _FACTORS[i]
    return _mixed(joined)


def labelled(joined: np.ndarray) -> np.ndarray:
    """The same with each k-mer's occurrence number in its hash."""
    count = len(joined)
    order = np.argsort(joined, kind="stable")
    ranked = joined[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return joined
    at = np.arange(count)
    label = np.empty(count, dtype=np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(label > 0, _mixed(joined + label * _FACTORS[0]), joined)


def kmers(text: str | None) -> np.ndarray:
    """64-bit hashes of the occurrence-labelled k-mers of a text, in text order."""
    return labelled(plain(text))


def sketch(labelled: np.ndarray) -> np.ndarray:
    """For each hash function the hash of the least labelled k-mers in text order."""
    best = np.full((SKETCHES, LEAST), np.uint64(2**64 - 1))
    for start in range(0, len(labelled), STEP):
        values = (labelled[start : start + STEP] >> np.uint64(16)).astype(np.uint32)[None, :] * _MULTIPLY + _ADD
        rows, found = np.arange(SKETCHES), []
        for _ in range(min(LEAST, values.shape[1])):
            at = values.argmin(1)
            found.append((values[rows, at].astype(np.uint64) << np.uint64(32)) + np.uint64(start) + at.astype(np.uint64))
            values[rows, at] = np.uint32(2**32 - 1)
        best = np.sort(np.concatenate([best, np.stack(found, 1)], axis=1), axis=1)[:, :LEAST]
    place = np.sort(np.where(best == np.uint64(2**64 - 1), np.uint64(0), best & np.uint64(2**32 - 1)), axis=1).astype(np.int64)
    out = np.zeros(SKETCHES, dtype=np.uint64)
    for i in range(LEAST):
        out = _mixed(out + labelled[place[:, i]] * _FACTORS[i])
    return out


def signature(labelled: np.ndarray) -> np.ndarray:
    """15 bits of the least k-mer in each hash range; 0 for an empty range."""
    ranked = np.sort(labelled)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(ranked, np.arange(BINS, dtype=np.uint64) << shift)
    found = ranked[np.minimum(first, len(ranked) - 1)]
    there = (first < len(ranked)) & (found >> shift == np.arange(BINS, dtype=np.uint64))
    return np.where(there, (found & np.uint64(0xFFFF)) | np.uint64(1), np.uint64(0)).astype(np.uint16)


def likely(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which signatures are near enough to one, nearest first."""
    used = np.maximum(((others != 0) | (mine != 0)).sum(1), 1)
    equal = ((others == mine) & (mine != 0)).sum(1)
    near = np.flatnonzero(equal >= used * SIMILAR - SLACK * np.sqrt(used * SIMILAR * (1 - SIMILAR)))
    return near[np.argsort(-equal[near] / used[near], kind="stable")]


def alignment(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> int:
    """Most k-mers that match in order, if that makes the texts similar; else 0 or a smaller count.

    Similar texts leave at most ``drift`` k-mers unmatched, so matches lie in a band that wide.
    K-mers come without labels: an occurrence may match any equal one in the band.
    """
    total = len(a) + len(b)
    needed = int(np.ceil(total * similar / (1 + similar) - 1e-9))
    if min(len(a), len(b)) < needed:
        return 0
    drift = total - 2 * needed
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    unlike = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(unlike[0]) if len(unlike) else short - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(x) or not len(y):
        return head + tail
    order = np.argsort(y, kind="stable")
    if _repeats(y[order]):
        if _repeats(np.sort(x)):
            return head + tail + _aligned(x, y, drift, needed - head - tail)
        x, y, order = y, x, np.argsort(x, kind="stable")
    at = np.searchsorted(y, x, sorter=order)
    at[at == len(y)] = 0
    there = order[at]
    keep = (y[there] == x) & (np.abs(there - np.arange(len(x))) <= drift)
    places = there[keep]
    if head + tail + len(places) < needed:
        return 0
    if (np.diff(places) > 0).all():
        return head + tail + len(places)
    ends: list[int] = []
    for place in places.tolist():
        where = bisect_left(ends, place)
        ends[where : where + 1] = [place]
    return head + tail + len(ends)


def _repeats(ranked: np.ndarray) -> bool:
    return bool((ranked[1:] == ranked[:-1]).any())


def _aligned(x: np.ndarray, y: np.ndarray, drift: int, needed: int) -> int:
    """``alignment`` where both repeat k-mers: rows of the table of common subsequences, as bits of integers.

    A zero bit says that the row grows at that column; ``ROWS_AT_ONCE`` rows share a window of columns.
    """
    own, of_x, n_x = np.unique(x, return_inverse=True, return_counts=True)
    other, of_y, n_y = np.unique(y, return_inverse=True, return_counts=True)
    common, in_x, in_y = np.intersect1d(own, other, assume_unique=True, return_indices=True)
    if np.minimum(n_x[in_x], n_y[in_y]).sum() < needed:
        return 0
    number = np.full(len(own), -1), np.full(len(other), -1)
    number[0][in_x] = number[1][in_y] = np.arange(len(common))
    rows, columns = number[0][of_x], number[1][of_y]
    at, to = np.flatnonzero(rows >= 0), np.flatnonzero(columns >= 0)
    rows, columns = rows[at], columns[to]
    low, width, bits, done = 0, 0, 0, 0
    for start in range(0, len(rows), ROWS_AT_ONCE):
        part = rows[start : start + ROWS_AT_ONCE]
        left = int(np.searchsorted(to, at[start] - drift))
        right = int(np.searchsorted(to, at[start + len(part) - 1] + drift, side="right"))
        if left > low:  # columns that no later row can match
            gone = min(left - low, width)
            done += gone - (bits & ((1 << gone) - 1)).bit_count()
            bits, width, low = bits >> gone, width - gone, left
        if right - low > width:
            bits |= ((1 << (right - low - width)) - 1) << width
            width = right - low
        full = (1 << width) - 1
        window, equal = columns[low : low + width], {}
        order = np.argsort(window, kind="stable")
        ranked, kinds = window[order], np.unique(part)
        for kind, a, b in zip(kinds.tolist(), np.searchsorted(ranked, kinds).tolist(), np.searchsorted(ranked, kinds, side="right").tolist()):
            places = np.zeros(width, dtype=np.uint8)
            places[order[a:b]] = 1
            equal[kind] = int.from_bytes(np.packbits(places, bitorder="little").tobytes(), "little")
        for kind in part.tolist():
            met = bits & equal[kind]
            bits = ((bits + met) | (bits - met)) & full
        found = done + width - bits.bit_count()
        if found + len(rows) - start - len(part) < needed:
            return 0
    return done + width - bits.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    matches = alignment(a, b)
    return matches * (1 + SIMILAR) >= (len(a) + len(b)) * SIMILAR - 1e-6


def _sketches(texts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts:
        rows: tuple[list, ...] = ([], [], [], [], [])
        taken, size = 0, 0
        for text in batch.column(1):
            bare = plain(text.as_py())
            own = labelled(bare)
            for column, value in zip(rows, (blake2b(own.tobytes(), digest_size=16).digest(), len(own), sketch(own).view(np.int64), signature(own).tobytes(), (bare >> np.uint64(32)).astype(np.uint32).tobytes())):
                column.append(value)
            size += len(own)
            if size > 1 << 21:
                yield _batch(batch.column(0).slice(taken, len(rows[0])), *rows)
                taken, size, rows = taken + len(rows[0]), 0, ([], [], [], [], [])
        if rows[0]:
            yield _batch(batch.column(0).slice(taken, len(rows[0])), *rows)
        pa.default_memory_pool().release_unused()


def _batch(ids: pa.Array, marks: list, sizes: list, keys: list, bins: list, arrays: list) -> pa.RecordBatch:
    flat = pa.array(np.concatenate(keys), pa.int64())
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * SKETCHES, pa.int32()), flat)
    return pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), listed, pa.array(bins, pa.binary()), pa.array(arrays, pa.binary())], names=["id", "mark", "size", "keys", "bins", "kmers"])


def sketched(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Row number, id, digest and number of k-mers, sketches, signature, and the 32-bit hashes of the k-mers without labels."""
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_sketches, f"id {kind}, mark binary, size bigint, keys array<bigint>, bins binary, kmers binary").withColumn("row", F.monotonically_increasing_id())


def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(a, b)], pa.bool_())


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of row numbers whose texts are similar.

    The k-mers of texts that take part are picked by a bit table of fixed size first.
    """
    needed = pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row")))
    own = may_be_among(texts.select("row", "kmers"), needed, "row", "needed").filter("needed").select("row", "kmers")
    met = pairs.join(own.select(F.col("row").alias("u"), F.col("kmers").alias("a")), "u").join(own.select(F.col("row").alias("v"), F.col("kmers").alias("b")), "v")
    return met.select("u", "v", F.arrow_udf(_similar, "boolean")("a", "b").alias("similar")).filter("similar").select("u", "v")


#: A cell is a group's block, or two of them; its rows have these columns.
CELL = ["which", "key", "a", "b"]
ROWS = [*CELL, "part", "row", "label", "keys", "bins"]


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each cell, of rows that come sorted by cell."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_numpy() for i in range(len(CELL))]
        if held and any(held[-1].column(i)[0].as_py() != names[i][0] for i in range(len(CELL))):
            yield whole()
            held = []
        edges = np.flatnonzero(np.any([np.diff(n) != 0 for n in names], axis=0)) + 1
        bounds = [0, *edges.tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:]):
            held.append(batch.slice(start, stop - start))
            if stop < batch.num_rows:
                yield whole()
                held = []
    if held:
        yield whole()


def _candidates(cell: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a cell those that it meets here first, in another component, and may be similar to, likeliest first."""
    which, _, a, b = (cell.column(i)[0].as_py() for i in range(len(CELL)))
    part, labels = cell.column(4).to_numpy(), cell.column(6).to_numpy()
    if (labels == labels[0]).all():
        return
    keys = cell.column(7).flatten().to_numpy().reshape(len(labels), SKETCHES)
    bins = np.frombuffer(b"".join(cell.column(8).to_pylist()), np.uint16).reshape(len(labels), BINS)
    second = np.arange(len(labels)) if a == b else np.flatnonzero(part == 1)
    for i in range(len(labels)) if a == b else np.flatnonzero(part == 0):
        other = second[second > i] if a == b else second
        other = other[labels[other] != labels[i]]
        if which:
            other = other[~(keys[other, :which] == keys[i, :which]).any(1)]
        other = other[likely(bins[i], bins[other])] if len(other) else other
        if len(other):
            yield int(i), other


def _likeliest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's first candidates (u, v); a cell where a row has more is told by a row without u."""
    names, out = ["u", "v", *CELL], []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for cell in _cells(batches):
        rows, more = cell.column(5).to_numpy(), False
        for i, others in _candidates(cell):
            more |= len(others) > FIRST
            out.extend((int(min(rows[i], v)), int(max(rows[i], v)), None, None, None, None) for v in rows[others[:FIRST]])
        if more:
            out.append((None, None, *(cell.column(i)[0].as_py() for i in range(len(CELL)))))
        if len(out) > 1 << 14:
            yield batch()
            out = []
    if out:
        yield batch()


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that join a cell's components: all candidates are aligned, but for those that links already join."""
    for cell in _cells(batches):
        rows, labels, joined, links = cell.column(5).to_numpy(), cell.column(6).to_numpy(), {}, []

        def root(label: int) -> int:
            while label in joined:
                label = joined[label]
            return label

        arrays: dict[int, np.ndarray] = {}

        def kmers_of(i: int) -> np.ndarray:
            if i not in arrays:
                arrays[i] = np.frombuffer(cell.column(9)[i].as_py(), np.uint32)
            return arrays[i]

        for i, others in _candidates(cell):
            for j in others.tolist():
                mine, other = root(labels[i]), root(labels[j])
                if mine != other and similar(kmers_of(i), kmers_of(j)):
                    joined[max(mine, other)] = min(mine, other)
                    links.append((int(min(rows[i], rows[j])), int(max(rows[i], rows[j]))))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, class_id (the least id of its class), class_size, kept."""
    texts = settled(sketched(documents, key, text))
    copies = settled(texts.groupBy("mark", "size").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    members = settled(texts.select("row", "id", "mark", "size").join(copies, ["mark", "size"], "left").select("row", "id", F.coalesce("first", "row").alias("first")))
    different = texts.select("row", "keys").join(members.filter("row = first").select("row"), "row")
    groups = different.select("row", F.posexplode("keys").alias("which", "key"))
    shared = settled(groups.groupBy("which", "key").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    groups = settled(groups.join(shared, ["which", "key"]))
    links = links_of_leaders = settled(verified(groups.filter("row <> leader").select(F.col("leader").alias("u"), F.col("row").alias("v")).distinct(), texts))
    stars = components(links)
    label = F.coalesce("v", "row")
    labelled = groups.join(stars.withColumnRenamed("u", "row"), "row", "left").select("which", "key", "row", "leader", "n", label.alias("label"))
    others = F.when(F.col("row") != F.col("leader"), F.col("label"))  # pairs with the leader have been verified
    open_groups = settled(labelled.groupBy("which", "key").agg(F.min(others).alias("low"), F.max(others).alias("high")).filter("low <> high").select("which", "key"))
    left = settled(labelled.filter("n > 2").join(open_groups, ["which", "key"]).filter("row <> leader").drop("leader"))
    if left.limit(1).count():
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("row"), blocks).cast("int")
        cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), F.when(own <= other, 0).otherwise(1).alias("part")))
        dealt = left.select("which", "key", "row", "label", F.explode(cells).alias("c")).select("which", "key", "c.a", "c.b", "c.part", "row", "label")
        dealt = settled(dealt)
        sorted_cells = lambda rows: rows.repartition(*CELL).sortWithinPartitions(*CELL, "part", "row")

        def joined(rows: DataFrame, *columns: str) -> DataFrame:
            """Rows with columns of their texts; of the texts only those are shuffled that take part."""
            own = may_be_among(texts.select("row", *columns), rows.select("row"), "row", "needed").filter("needed").drop("needed")
            return rows.join(own, "row").select(*ROWS, *columns[2:])

        first = settled(sorted_cells(joined(dealt, "keys", "bins")).mapInArrow(_likeliest, "u bigint, v bigint, which int, key bigint, a int, b int"))
        links = settled(links.unionByName(verified(first.filter("u is not null").select("u", "v").distinct(), texts)))
        stars = components(links)
        unfinished = first.filter("u is null").select(*CELL)
        if unfinished.limit(1).count():
            rest = dealt.join(unfinished, CELL).drop("label")
            rest = rest.join(stars.withColumnRenamed("u", "row"), "row", "left").withColumn("label", label)
            rest = settled(rest.select(*CELL, "part", "row", "label"))
            links = links.unionByName(settled(sorted_cells(joined(rest, "keys", "bins", "kmers")).mapInArrow(_finished, "u bigint, v bigint")))
            stars = components(links)
    found = members.join(stars.select(F.col("u").alias("first"), "v"), "first", "left").select("row", "id", F.coalesce("v", "first").alias("label"))
    found = settled(found)
    release(texts, copies, members, shared, groups, links_of_leaders, open_groups, left)  # what follows reads ``found`` alone
    sizes = settled(found.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct("id", "row")).alias("least")).filter("class_size > 1"))
    alone = F.col("class_size").isNull()
    return found.join(sizes, "label", "left").select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (alone | (F.col("row") == F.col("least.row"))).alias("kept")
    )
