r"""Exact duplicates by composable polynomial fingerprints, confirmed by streaming comparison.

A text's bytes are the digits of a number, taken modulo two primes. The value of two joined
chunks is ``value(a) * base ** len(b) + value(b)``, so chunks are hashed apart (in parallel
tasks for texts over ``HUGE`` characters) and combined. Fingerprints that several rows have set bits in a
table of fixed size; only texts whose bit is set are compared. Each task first compares what it holds
itself and sends one text for each fingerprint, so a text with very many copies is not sent once for each of
them. Texts are sent and compared in chunks of ``SENT`` bytes, sorted by place: a task holds one
chunk, whatever the texts' sizes. Only a text that differs from its fingerprint's first text leads to more than
one class for it.

Texts are equal when identical after each run of ASCII white space is one space. Defined
cases: null text is empty; of rows with the same smallest id, the first read stays; a null id is
smallest; an empty table gives an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.shared import settled

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 214_013_531)
#: Bytes that are hashed, and compared, at a time.
CHUNK = 1024
#: Characters above which a text's slices are hashed by tasks of their own.
HUGE = 1 << 22
SLICE = 1 << 20
#: Bytes of texts that a task keeps for comparing what it reads itself.
KEPT = 16 << 20
#: Bytes of a text that are sent and compared at a time, and bits of the table of fingerprints (a megabyte).
SENT, BITS = 1 << 16, 1 << 23
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def _powers(base: int, prime: int) -> np.ndarray:
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.int64)


_POWERS = np.stack([_powers(b, p) for b, p in zip(BASES, PRIMES)], axis=1)
_SHIFTS = tuple(pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES))


def normal(data: bytes) -> bytes:
    data = data.translate(_SPACES)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def combine(left: tuple[int, ...], right: tuple[int, ...], size: int) -> tuple[int, ...]:
    """The fingerprint of two joined texts, from theirs and the second one's length."""
    return tuple((a * pow(base, size, p) + b) % p for a, b, base, p in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> tuple[int, int]:
    """The value of the bytes modulo each prime; chunks are hashed at once, then combined."""
    lead = -len(data) % CHUNK  # leading zeros leave the value as it is
    chunks = np.zeros(lead + len(data), dtype=np.uint8)
    chunks[lead:] = np.frombuffer(data, dtype=np.uint8)
    out = [0, 0]
    for values in (chunks.reshape(-1, CHUNK).astype(np.int64) @ _POWERS).tolist():
        out = [(h * s + v) % p for h, s, v, p in zip(out, _SHIFTS, values, PRIMES)]
    return out[0], out[1]


MARKS = "struct<h1:bigint,h2:bigint,n:bigint,sha:string>"


def _marks(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.cast(pa.binary()):
        data = normal(text.as_py() or b"")
        h1, h2 = fingerprint(data)
        rows.append({"h1": h1, "h2": h2, "n": len(data), "sha": hashlib.sha256(data).hexdigest()})
    return pa.array(rows, pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sha", pa.string())]))


def _cut(size: int):
    """Slices of normalised huge texts, a few at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                data = normal(texts[i].as_py())
                sha = hashlib.sha256(data).hexdigest()
                for at, start in enumerate(range(0, len(data), size)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([sha]), pa.array([at], pa.int32()), pa.array([data[start : start + size]], pa.binary())], names=["id", "row", "sha", "at", "slice"])

    return run


def _slices(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        data = text.as_py()
        (h1, h2), (s1, s2) = fingerprint(data), (pow(b, len(data), p) for b, p in zip(BASES, PRIMES))
        rows.append({"h1": h1, "h2": h2, "s1": s1, "s2": s2, "n": len(data)})
    return pa.array(rows, pa.struct([(c, pa.int64()) for c in ("h1", "h2", "s1", "s2", "n")]))


def mark(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's id, running number, fingerprint, length in bytes and SHA-256."""
    rows = documents.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    usual = rows.filter(F.length("text") <= HUGE).select("id", "row", F.arrow_udf(_marks, MARKS)("text").alias("m")).select("id", "row", "m.*")
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.filter(F.length("text") > HUGE).select("id", "row", "text").mapInArrow(_cut(SLICE), f"id {kind}, row bigint, sha string, at int, slice binary")
    hashed = cut.repartition("row", "at").select("id", "row", "sha", "at", F.arrow_udf(_slices, "struct<h1:bigint,h2:bigint,s1:bigint,s2:bigint,n:bigint>")("slice").alias("m"))
    listed = hashed.groupBy("row").agg(F.first("id").alias("id"), F.first("sha").alias("sha"), F.sum("m.n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "m"))).alias("parts"))

    def folded(h: str, s: str, prime: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x.m[s] + x.m[h]) % prime)

    joined = listed.select("id", "row", folded("h1", "s1", PRIMES[0]).alias("h1"), folded("h2", "s2", PRIMES[1]).alias("h2"), "n", "sha")
    return usual.unionByName(joined)


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison; ends at the first chunk that differs."""
    step = CHUNK * 64
    return len(a) == len(b) and all(a[i : i + step] == b[i : i + step] for i in range(0, len(a), step))


_SENT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("sha", pa.binary()), ("data", pa.binary())])
SCHEMA = "h1 bigint, h2 bigint, n bigint, at int, sha binary, data binary"


def _bit(h1, h2):
    return (h1 * 2_654_435_761 + h2) % BITS


def repeated(marks: DataFrame) -> np.ndarray:
    """A table of bits: set for every fingerprint that several rows have (some others share its bits)."""
    many = marks.groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(_bit(F.col("h1"), F.col("h2")).alias("bit"))
    words = many.groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()  # at most BITS / 32 rows
    table = np.zeros(BITS // 32, dtype="<u4")
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _sent(batches: Iterable[pa.RecordBatch], wanted: np.ndarray | None = None, fingerprint=fingerprint) -> Iterator[pa.RecordBatch]:
    """The chunks of one text for each wanted fingerprint that the task meets, and of every text that differs from it."""
    kept: dict[tuple[int, int, int], bytes] = {}
    size = 0
    rows: list[tuple] = []
    pending = 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            data = normal(text.as_py() or b"")
            h1, h2 = fingerprint(data)
            if wanted is not None and not wanted[_bit(h1, h2)]:
                continue
            key = (h1, h2, len(data))
            first = kept.get(key)
            if first is not None and same(first, data):
                continue
            if first is None:
                if size > KEPT:
                    kept.clear()
                    size = 0
                kept[key] = data
                size += len(data)
            sha = hashlib.sha256(data).digest()
            for at, start in enumerate(range(0, max(len(data), 1), SENT)):
                chunk = data[start : start + SENT]
                rows.append((*key, at, sha, chunk))
                pending += len(chunk)
                if pending > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)
                    rows, pending = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)


def _differing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks sorted by fingerprint, place and SHA-256, those that are not like the first at their place; that is always the same text's."""
    key, first = None, b""
    for batch in batches:
        rows = []
        h1, h2, n, at, sha, data = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            own = (h1[i].as_py(), h2[i].as_py(), n[i].as_py(), at[i].as_py())
            if own != key:
                key, first = own, data[i].as_py()
            elif first != data[i].as_py():
                rows.append((*own[:3], sha[i].as_py().hex()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["h1", "h2", "n", "sha"])


def collisions(documents: DataFrame, text: str, wanted: np.ndarray | None = None, sent=_sent) -> DataFrame:
    """Fingerprint and SHA-256 of texts that differ from the first text of their fingerprint."""
    told = documents.sparkSession.sparkContext.broadcast(wanted)
    texts = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(lambda batches: sent(batches, told.value), SCHEMA)
    dealt = texts.repartition("h1", "h2", "n", "at").sortWithinPartitions("h1", "h2", "n", "at", "sha")
    return dealt.mapInArrow(_differing, "h1 bigint, h2 bigint, n bigint, sha string").distinct()


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text", marks: DataFrame | None = None, differing: DataFrame | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    marks = settled(mark(documents, key, text)) if marks is None else marks
    differing = settled(collisions(documents, text, repeated(marks))) if differing is None else differing
    by = ["h1", "h2", "n", "variant"]
    if differing.limit(1).count():
        marks = marks.join(differing.withColumn("variant", F.col("sha")), ["h1", "h2", "n", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
    else:
        marks = marks.withColumn("variant", F.lit(""))
    groups = marks.groupBy(*by).agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    found = marks.join(groups, by)
    return found.select(F.col("id").alias(key), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256"))
