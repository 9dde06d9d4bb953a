"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import stored


class Forest:
    """Union of array positions or hashable keys; the smaller key becomes the root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low

    def stars(self) -> list[tuple]:
        """(node, root) of every node that is not its own root."""
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def _contracted(links: DataFrame) -> DataFrame:
    """The same components with at most one link for each node a task has seen, in steps of bounded memory."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest = Forest()
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if stars := forest.stars():
                rows = np.array(stars, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

    return links.mapInArrow(contract, "a long, b long")


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over links a > b: every node's larger (or not larger) neighbours link to its least neighbour.

    The least neighbour is a partial aggregate, and it is joined to the links rather than gathered with them, so a node
    with very many links is split like any skewed join key.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    found = both.join(least, "a")
    if large:
        return found.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    away = found.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return away.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with a link; links are long columns a and b.

    Links to itself, repeated links and links with nulls change nothing.  Every step is written to the shared folder and read
    again, so a lost executor costs one step; the steps end when nothing changes.
    """
    plain = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(_contracted(plain).distinct(), "links")
    mark = None
    while True:
        then, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == then or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select("b", "b").distinct().toDF("node", "component")
            )
        now = stored(_stars(_stars(now, large=True), large=False), "links")
