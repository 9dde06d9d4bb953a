"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

A shared tree has one leaf, the home, for every fingerprint: each node has a vantage fingerprint and radii, and a fingerprint goes
to the shell that its Hamming distance from the vantage falls into.  By the triangle inequality a link of ``radius``
bits can cross to the next inner shell only from within ``radius`` bits of the border.  Such fingerprints visit that shell
too, and below it every shell that may hold a link of theirs; homes of a leaf are compared with each other and with its
visitors, so every pair meets in one leaf.  Tasks search leaves by two vantages of their own, and compare only cells of points
whose distances from both are near.  The search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import slices, stored
from shelfmark.llm.components import Forest, components

RADIUS = 4
SHINGLE = 4
#: Fingerprints on which the shared tree is fitted, at most; homes up to which a leaf is not split further; fingerprints of a leaf,
#: too dense to be split, beyond which it is dealt out in blocks.
SAMPLE, LEAF, BLOCK = 20_000, 65_536, 262_144
SEED = 42
#: Points of a leaf that are compared without cells, and side of the squares in which points are compared.
FEW, SIDE = 1024, 1024


def fingerprint(text: str | None) -> int:
    """SimHash of 4-word shingles of the text with A-Z in lower case, repeats included; 0 without a word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    n = max(1, len(words) - SHINGLE + 1)
    start, end = start[:n], end[min(SHINGLE, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # a very long text needs no more memory than this
        spans = zip(start[at : at + 65536].tolist(), end[at : at + 65536].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """row (its place in the input), doc_id and fp (the fingerprint as a signed long) of every row; a null text has no word."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found)], names=["row", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(printed, "row long, doc_id long, fp long")


@dataclass
class Node:
    """A vantage with ascending radii and one child for each shell, or a leaf with its number."""

    vantage: np.uint64 | None = None
    radii: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


def shells(points: np.ndarray, home: np.ndarray, vantage: np.uint64, radii: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, which of them are at home) by shell.

    A home also visits the next inner shell from within ``radius`` of its border; a visitor goes to every shell that it may link to.
    """
    distance = np.bitwise_count(points ^ vantage).astype(int)
    out, inner = [], -1
    for outer in [*radii.tolist(), 64]:
        own = (distance > inner) & (distance <= outer)
        near = (distance <= outer + radius) & (home & (distance > outer) | ~home & (distance > inner - radius))
        at = np.flatnonzero(own & home | near)
        out.append((at, (own & home)[at]))
        inner = outer
    return out


def comparisons(parts: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Pairs of homes, and of homes and visitors, in all parts."""
    return sum((n := int(home.sum())) * (n / 2 + len(home) - n) for _, home in parts)


def split(points: np.ndarray, home: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, np.ndarray] | None:
    """Of some vantages and radii, ``radius`` + 1 apart or more, those with the fewest comparisons; None if none is worth it."""
    best, found = 0.85 * comparisons([(points, home)]), None
    at_home = points[home]
    for vantage in at_home[rng.choice(len(at_home), min(6, len(at_home)), replace=False)]:
        middle = int(np.median(np.bitwise_count(at_home ^ vantage)))
        for shift in (0, 2):
            steps = (radius + 1) * np.arange(-6, 7) + middle + shift
            radii = steps[(steps >= 0) & (steps < 64)]
            cost = comparisons(shells(points, home, vantage, radii, radius))
            if cost < best:
                best, found = cost, (vantage, radii)
    return found


def build(sample: np.ndarray, total: int, radius: int = RADIUS, leaf: int = LEAF) -> tuple[Node, int]:
    """A tree whose leaves are home to about ``leaf`` of ``total`` fingerprints at most, and the number of leaves."""
    rng = np.random.default_rng(0)
    scale = total / max(1, len(sample))
    leaves = 0

    def grown(points: np.ndarray, home: np.ndarray) -> Node:
        nonlocal leaves
        n = int(home.sum())
        made = split(points, home, radius, rng) if n * scale > leaf and n >= 32 else None
        if made is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        return Node(*made, [grown(points[at], own) for at, own in shells(points, home, *made, radius)])

    return grown(sample, np.ones(len(sample), bool)), leaves


def routed(tree: Node, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf numbers, indices of the points sent there, and whether they are at home there."""
    found = []
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node.vantage is None:
            found.append((np.full(len(at), node.leaf), at, home))
            continue
        parts = shells(points[at], home, node.vantage, node.radii, radius)
        todo += [(child, at[part], own) for child, (part, own) in zip(node.children, parts, strict=True)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _dense(points: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, forest: Forest) -> None:
    """All links between the points at ``left`` and at ``right`` (None: among those at ``left``), in squares of bounded size.

    Only a forest of the links is kept.
    """
    side = SIDE
    for i in range(0, len(left), side):
        rows = left[i : i + side]
        for j in range(i if right is None else 0, len(left if right is None else right), side):
            columns = (left if right is None else right)[j : j + side]
            near = np.bitwise_count(points[rows][:, None] ^ points[columns][None, :]) <= radius
            same = right is None and i == j
            if same:
                near = np.triu(near, 1)
            count = np.count_nonzero(near)
            if count <= 4 * side:
                for at in np.flatnonzero(near).tolist() if count else []:
                    forest.join(int(rows[at // len(columns)]), int(columns[at % len(columns)]))
                continue
            # many links: repeated least labels give the square's components
            own = np.arange(len(rows))
            other = own if same else len(rows) + np.arange(len(columns))
            while True:
                a = np.minimum(own, np.where(near, other[None, :], len(rows) + side).min(1))
                b = np.minimum(other, np.where(near, a[:, None], len(rows) + side).min(0))
                if same:
                    a = b = np.minimum(a, b)
                if (a == own).all() and (b == other).all():
                    break
                own, other = a, b
            both = np.concatenate([rows, columns])
            for k, label in enumerate(np.concatenate([own, other]).tolist()):
                if label != k:
                    forest.join(int(both[k]), int(both[label]))


def linked(points: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (index, smaller index) whose components are those of all pairs, with a home, within ``radius`` bits.

    Points lie in cells by their distances from two vantages, 32 bits from each other or nearly so; pairs whose distances from
    either differ by more than ``radius`` cannot link.  In the order of the cells, those that can are a few ranges.
    """
    forest = Forest()
    homes, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    if len(points) <= FEW:
        _dense(points, homes, None, radius, forest)
        _dense(points, homes, visitors, radius, forest)
        return forest.stars()
    one = points[homes[0]]
    apart = np.abs(np.bitwise_count(points[homes] ^ one).astype(int) - 32)
    two = points[homes[int(apart.argmin())]]

    def in_cells(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = (np.bitwise_count(points[at] ^ v).astype(int) for v in (one, two))
        cell = first * 128 + second
        order = np.argsort(cell, kind="stable")
        return at[order], cell[order]

    homes, cell = in_cells(homes)
    visitors, visited = in_cells(visitors)
    cells, starts = np.unique(cell, return_index=True)
    ends = np.append(starts[1:], len(cell))
    for own, start, end in zip(cells.tolist(), starts.tolist(), ends.tolist(), strict=True):
        left = homes[start:end]
        _dense(points, left, None, radius, forest)
        for step in range(-radius, radius + 1):
            middle = own + 128 * step
            lowest, highest = middle - radius, middle + radius
            if step >= 0:
                a = np.searchsorted(cell, own + 1 if step == 0 else lowest)
                _dense(points, left, homes[a : np.searchsorted(cell, highest + 1)], radius, forest)
            a = np.searchsorted(visited, lowest)
            _dense(points, left, visitors[a : np.searchsorted(visited, highest + 1)], radius, forest)
    return forest.stars()


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that give the components of all pairs within ``radius`` bits.

    The shared tree is fitted on a bounded sample; every fingerprint is routed.  Leaves are tasks, one for each.  What no vantage
    splits is a dense group: one of more than ``BLOCK`` fingerprints is dealt out as pairs of blocks, so it is no single task.
    """
    total = prints.count()
    share = min(1.0, SAMPLE / max(1, total))
    chosen = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("fp").collect()
    sample = np.sort(np.array([r["fp"] for r in chosen], np.int64)).view(np.uint64)
    tree, _ = build(sample, total, radius)
    shared = prints.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            leaf, index, home = routed(shared.value, points, radius)
            columns = [pa.array(leaf, pa.int64()), pa.array(points[index].view(np.int64)), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "fp", "home"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        points, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(bool)
        block = group["block"].to_numpy()
        if (block == block[0]).all() and group["one"].iloc[0] == group["two"].iloc[0]:
            found = linked(points, home, radius) if home.any() else []
        else:
            forest = Forest()
            first = block == group["one"].iloc[0]
            _dense(points, np.flatnonzero(first & home), np.flatnonzero(~first), radius, forest)
            _dense(points, np.flatnonzero(~first & home), np.flatnonzero(first & ~home), radius, forest)
            found = forest.stars()
        found = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": points[found[:, 0]].view(np.int64), "b": points[found[:, 1]].view(np.int64)})

    leaves = stored(prints.select("fp").mapInArrow(route, "leaf long, fp long, home boolean"), "leaves")
    # a row for each leaf of the tree, which the sample bounds
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")).collect()
    dense = {r["leaf"]: r["blocks"] for r in sizes if r["blocks"] > 1}
    columns = ["leaf", "fp", "home", F.lit(0).alias("block"), F.lit(0).alias("one"), F.lit(0).alias("two")]
    dealt = leaves.where(~F.col("leaf").isin(list(dense))).select(*columns) if dense else leaves.select(*columns)
    for leaf, blocks in dense.items():
        own = leaves.where(F.col("leaf") == leaf).withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        ends = [F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")]
        dealt = dealt.unionByName(own.select("leaf", "fp", "home", "block", *ends))
    # every leaf a task, whatever its bytes: comparing is the work
    tasks = max(1, len(sizes) - len(dense) + sum(n * (n + 1) // 2 for n in dense.values()))
    dealt = dealt.repartition(tasks, "leaf", "one", "two")
    return dealt.groupBy("leaf", "one", "two").applyInPandas(search, "a long, b long")


def _components(prints: DataFrame, first: Column, radius: int) -> DataFrame:
    """Every distinct fingerprint with the smallest ``first`` of its component: fp, component, first."""
    distinct = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct_fingerprints")
    groups = components(links(distinct, radius)).toDF("fp", "component")
    named = distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    return named.drop("first").join(firsts, "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links) of every row.

    Equal fingerprints link like near ones; texts without a word share the fingerprint zero.  Null ids take part and get a
    component, but name none unless all ids of a component are null.  Copies are one fingerprint before anything is compared.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    classes = _components(prints, F.col("doc_id"), radius).select("fp", F.col("first").alias("component_id"))
    fingerprint_digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(classes, "fp").select("doc_id", fingerprint_digits.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (null first), then the first in the input.

    ``docs`` must give its rows in the same order each time it is read, as files do.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    kept = _components(prints, F.struct("doc_id", "row"), radius).select(F.col("first.row").alias("kept_row")).distinct()
    rows = docs.withColumn("row_of_input", F.monotonically_increasing_id())
    return rows.join(kept, F.col("row_of_input") == F.col("kept_row"), "left_semi").drop("row_of_input")
