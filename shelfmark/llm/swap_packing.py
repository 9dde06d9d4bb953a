"""Packing of document pieces into sequences by best fit and swap-based local search.

A packing starts best-fit-decreasing.  Then documents move between underfull bins, one is exchanged for one, or two for
one, wherever that raises the sum of squared fills, which drains the emptiest bins until they can be given up.  The
search ends when the bins are as few as the total length allows, when no such step is left, or when ``PATIENCE`` steps have not
emptied a bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import stored
from shelfmark.llm.token_pieces import CAPACITY, pieces
from shelfmark.llm.word_parts import REMEMBERED

#: Pieces packed together by one task.
GROUP = 10_000
#: Steps without a bin less after which a search ends; documents of a bin up to which pairs of them are tried.
PATIENCE, PAIRED = 150, 48


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices by bin, longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # bins by what is left in them
    open_rooms = 0  # bit r: a bin with r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        left -= size
        if left:
            room.setdefault(left, []).append(at)
            open_rooms |= 1 << left
    return bins


class _Search:
    """Bins under search: the fill of each, its documents, and the bin of each document, kept up to date step by step."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.fills = np.array([lengths[b].sum() for b in bins])
        self.items = np.concatenate([np.array(b, int) for b in bins])
        self.sizes = lengths[self.items]
        self.owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        self.at = {int(i): k for k, i in enumerate(self.items.tolist())}

    def _best(self, sums: np.ndarray, given: np.ndarray, owner: np.ndarray, source: int) -> tuple[int, int, int]:
        """The largest gain of another bin that gets one of the ascending ``sums`` for ``given``: (gain, which sum, which given)."""
        room = self.capacity - self.fills[owner]
        which = np.searchsorted(sums, given + room, side="right") - 1
        gain = sums[which] - given
        # taking from a bin no fuller than the other will be raises the sum of squared fills
        gain[(which < 0) | (owner == source) | (self.fills[owner] + gain <= self.fills[source])] = 0
        if not len(gain):
            return 0, 0, 0
        # of equal gains the one that leaves least room
        at = np.flatnonzero(gain == gain.max())
        k = int(at[(room[at] - gain[at]).argmin()])
        return int(gain[k]), int(which[k]), k

    def step(self, source: int, alive: np.ndarray) -> bool:
        """The best step that takes length from ``source`` and fills another bin; False if there is none."""
        own = sorted(self.bins[source], key=lambda i: self.lengths[i])
        sizes = self.lengths[own]
        nothing = np.zeros(len(alive), int)
        moves = self._best(sizes, nothing, alive, source)
        best, kind, found = moves[0], "move", moves
        single = self._best(sizes, self.sizes, self.owner, source)
        if single[0] > best:
            best, kind, found = single[0], "single", single
        if 2 <= len(own) <= PAIRED:
            first, second = np.triu_indices(len(own), 1)
            sums = sizes[first] + sizes[second]
            order = np.argsort(sums, kind="stable")
            pair = self._best(sums[order], self.sizes, self.owner, source)
            if pair[0] > best:
                best, kind, found = pair[0], "pair", pair
        if best <= 0:
            return False
        _, which, k = found
        group = [own[which]] if kind != "pair" else [own[first[order[which]]], own[second[order[which]]]]
        to = int(alive[k]) if kind == "move" else int(self.owner[k])
        back = [] if kind == "move" else [int(self.items[k])]
        for moved, old, new in ((group, source, to), (back, to, source)):
            for i in moved:
                self.bins[old].remove(i)
                self.bins[new].append(i)
                self.owner[self.at[i]] = new
        self.fills[source] -= best
        self.fills[to] += best
        return True


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Drain the emptiest bins into the others by moves and exchanges until that is impossible or pointless."""
    least = -(-int(lengths.sum()) // capacity)
    filled = [b for b in bins if lengths[b].sum() == capacity]
    under = [b for b in bins if lengths[b].sum() < capacity]
    if len(bins) <= least or len(under) < 2:
        return bins
    search = _Search(under, lengths, capacity)
    alive = np.arange(len(under))
    stuck = np.zeros(len(under), bool)
    steps = 0
    while steps < PATIENCE and len(filled) + len(alive) > least:
        able = alive[~stuck[alive] & (search.fills[alive] < capacity)]
        if len(able) < 1 or len(alive) < 2:
            break
        source = int(able[search.fills[able].argmin()])
        moved = False
        while search.bins[source] and steps < PATIENCE and search.step(source, alive):
            moved, steps = True, steps + 1
        if not search.bins[source]:
            steps = 0
            alive = alive[alive != source]
        if moved:
            stuck[:] = False  # fills have changed, so that bins that were stuck may move again
        else:
            stuck[source] = True
    return filled + [b for b in search.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices; every length is at least 1 and at most the capacity."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _packed(rows: DataFrame, count: int, capacity: int, turn: int) -> DataFrame:
    """Rows with sequence_id, offset and fill, packed in groups of about ``GROUP`` rows dealt by position."""
    groups = max(1, -(-count // GROUP))

    def packed(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.reset_index(drop=True)
        lengths = batch["length"].to_numpy()
        bins = pack(lengths, capacity)
        order = np.concatenate([np.array(b, int) for b in bins])
        sizes = np.array([len(b) for b in bins])
        first = np.cumsum(sizes) - sizes
        before = np.cumsum(lengths[order]) - lengths[order]
        out = batch.iloc[order].copy()
        out["offset"] = before - np.repeat(before[first], sizes)
        out["fill"] = np.repeat(np.add.reduceat(lengths[order], first), sizes)
        out["sequence_id"] = (turn << 59) + (int(batch["batch"].iloc[0]) << 32) + np.repeat(np.arange(len(bins)), sizes)
        return out[names]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    # few bytes and much work: groups stay tasks, whatever adaptive execution would make of their size
    dealt = dealt.repartition(groups, "batch")
    return dealt.groupBy("batch").applyInPandas(packed, schema)


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for every row of a stored table of pieces (doc_id, piece, start, length, ids_crc32).

    Groups of ``GROUP`` rows are packed by themselves, dealt by position so that neither a hot id nor copies meet; what is left
    in underfull sequences of all groups is packed once more.
    """
    count = rows.count()
    first = _packed(rows, count, capacity, 0)
    if count <= GROUP:
        return first.drop("fill")
    first = stored(first, "packed")
    under = first.where(F.col("fill") < capacity)
    left = stored(under.select("doc_id", "piece", "start", "length", "ids_crc32"), "underfull")
    second = _packed(left, left.count(), capacity, 1)
    return first.where(F.col("fill") == capacity).unionByName(second).drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null text counts as empty and is the end id alone; null and repeated ids are ordinary rows; an empty table gives none.
    Offsets are gapless from 0 in every sequence.
    """
    return pack_pieces(stored(pieces(docs, tokenizer, capacity, remembered=remembered), "pieces"), capacity)

