"""Packed token-id matrices: best-fit-decreasing with a segment tree over capacities.

Documents are tokenized whole, cut losslessly where they are longer than a sequence, and packed.  A packed row is a
fixed number of ids, as little-endian 32-bit bytes, with the cumulative lengths of its segments and the places where
positions start again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.token_pieces import CAPACITY, END, pieces

#: UTF-8 bytes of text whose pieces one task packs.
GROUP_BYTES = 16 << 20


class CapacityTree:
    """Counts of open bins by remaining capacity, summed up a binary tree; finds the least sufficient one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += change
            at >>= 1

    def least(self, room: int) -> int | None:
        """The smallest remaining capacity of at least ``room`` that an open bin has."""
        at = room + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to a node whose right neighbour has a bin
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin; every length is at least 1 and at most the capacity."""
    tree, bins, open_bins = CapacityTree(capacity), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            room, at = capacity, len(bins)
            bins.append([])
        else:
            at = open_bins[room].pop()
            tree.add(room, -1)
        bins[at].append(i)
        room -= lengths[i]
        if room:
            open_bins.setdefault(room, []).append(at)
            tree.add(room, 1)
    return bins


PACKED = (
    "sequence_id long, length int, ids binary, cumulative_lengths array<int>, position_resets array<int>, "
    "doc_ids array<long>, pieces array<int>"
)


def packed_matrices(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """One row for each packed sequence.

    ``ids`` has ``capacity`` ids, those beyond ``length`` are ``pad``.  ``cumulative_lengths`` goes from 0 to ``length`` over the
    segments; ``position_resets`` are the segments' first places; ``doc_ids`` and ``pieces`` name the segments.  A null text
    counts as empty and is the end id alone; null and repeated ids are ordinary rows.  Pieces are dealt to groups by
    position, so that neither a hot id nor copies meet in one; each group shuffles its ids once.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // GROUP_BYTES))

    def packed(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_pylist()
        ids = table["ids"].combine_chunks()
        doc_ids, piece = table["doc_id"].to_pylist(), table["piece"].to_pylist()
        base = table["batch"][0].as_py() << 32
        rows = []
        for number, members in enumerate(best_fit_decreasing(lengths, capacity)):
            ends = np.cumsum([0] + [lengths[i] for i in members])
            raw = b"".join(ids[i].as_py() for i in members)
            padding = np.full(capacity - int(ends[-1]), pad, "<u4").tobytes()
            rows.append((
                base + number, int(ends[-1]), raw + padding, ends.tolist(), ends[:-1].tolist(),
                [doc_ids[i] for i in members], [piece[i] for i in members],
            ))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["sequence_id", "length", "ids", "cumulative_lengths", "position_resets", "doc_ids", "pieces"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cut = pieces(docs, tokenizer, capacity, END, with_ids=True).select("doc_id", "piece", "length", "ids")
    dealt = cut.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("batch").applyInArrow(packed, PACKED)


def write_matrices(docs: DataFrame, path: str, tokenizer: str, capacity: int = CAPACITY) -> None:
    """Write the packed rows; every ``ids`` is ``4 * capacity`` bytes, so a column chunk is a matrix of ids."""
    packed_matrices(docs, tokenizer, capacity).write.parquet(path)


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_id, piece, ids (little-endian 32-bit) of every segment: the round trip of ``packed_matrices``."""
    at = F.posexplode("doc_ids").alias("k", "doc_id")
    rows = packed.select("ids", "pieces", "cumulative_lengths", at)
    start, end = F.get("cumulative_lengths", F.col("k")), F.get("cumulative_lengths", F.col("k") + 1)
    return rows.select("doc_id", F.get("pieces", F.col("k")).alias("piece"), F.substring("ids", start * 4 + 1, (end - start) * 4).alias("ids"))
