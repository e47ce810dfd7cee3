"""Packing of tokenised documents into sequences: first-fit decreasing in randomised groups.

Documents are cut into pieces of at most the sequence length. Pieces, not documents, are dealt at random (by
hash) into groups, as many as there are ``GROUP`` documents: so a group of very long documents is as
large as any. In each, the longest piece comes first and goes to the
first sequence with room, which a tournament tree of the sequences' free space finds
in a logarithmic number of steps. Only lengths and checksums are shuffled, not the tokens.

Defined cases: null text is empty and gives the end token alone; repeated rows are packed each;
an empty table gives an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.bpe import codec

LENGTH = 4096
#: Documents in a group; more leave less padding and take more memory (some 100 bytes each).
GROUP = 8192
END_ID = 2


class FirstFit:
    """Sequences by number; each inner node holds the most room below it."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first sequence with room for ``size``, which it takes."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no sequence has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return found


def first_fit_decreasing(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """For each piece its sequence and its offset there."""
    sequences, offsets = [0] * len(sizes), [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    whole = 0
    while whole < len(order) and sizes[order[whole]] == length:
        sequences[order[whole]] = whole
        whole += 1
    tree, used = FirstFit(len(order) - whole, length), {}
    for i in order[whole:]:
        at = tree.place(sizes[i])
        sequences[i], offsets[i] = whole + at, used.get(at, 0)
        used[at] = offsets[i] + sizes[i]
    return sequences, offsets


def pieces(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Each document's pieces: id, start, length, ids_crc32, doc_tokens."""
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [])
            for row, ids in enumerate(own.encode_all(t.as_py() for t in batch.column(1))):
                data = memoryview(ids + end_id.to_bytes(4, "little"))
                total = len(data) // 4
                for start in range(0, total, length):
                    size = min(length, total - start)
                    for column, value in zip(out, (row, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(cut: DataFrame, documents: int, length: int = LENGTH, group: int = GROUP, seed: int = 17) -> DataFrame:
    """``cut`` with group-wise unique sequence_id, offset and the sequence's padded_length.

    A sequence is padded to ``length``; one that ends at a power of two stays as it is.
    """
    groups = max(1, -(-documents // group))
    dealt = cut.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("bin_group", F.pmod(F.xxhash64(F.lit(seed), F.col("row"), F.col("start"), F.col("ids_crc32")), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row", kind="stable")
        sequence, offset = first_fit_decreasing(own["length"].tolist(), length)
        own["sequence_id"] = (int(own["bin_group"].iloc[0]) << 32) + pd.Series(sequence, index=own.index, dtype="int64")
        own["offset"] = pd.Series(offset, index=own.index, dtype="int64")
        total = own.groupby("sequence_id")["length"].transform("sum")
        own["padded_length"] = total.where((total & (total - 1)) == 0, length).astype("int64")
        return own.drop(columns=["row", "bin_group"])

    return dealt.groupBy("bin_group").applyInPandas(run, f"{schema}, sequence_id bigint, offset bigint, padded_length bigint")
