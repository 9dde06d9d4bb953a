"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get global numbers 0 to n-1 in the order of (doc_id, checksum, size); a keyed Feistel network with cycle walking
permutes these numbers; the permuted number modulo the shard count is the shard, divided by it the slot.  Both directions
are arithmetic, so the place of a row and the row at a place can be computed without the table.

Shard counts differ by one row at most (law ``rows``).  Copies of a text are placed each by its own number, so a group of
copies spreads over all shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.base import stored

ROUNDS = 4


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _grid(n: int) -> tuple[int, int]:
    """Sides of a near-square grid that holds the numbers 0 to n-1; fewer than ``a`` of its cells are spare."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _network(x: Column, n: int, seed: int, forward: bool) -> Column:
    """One pass of the network over the grid's cells, or of its inverse: rows and columns shift each other in turn."""
    a, b = (_long(side) for side in _grid(n))

    def shift(value: Column, by: Column, key: Column, side: Column) -> Column:
        step = F.pmod(F.xxhash64(_long(seed), key, by), side)
        return F.pmod(value + step if forward else value - step, side)

    def turn(cell: Column, j: Column) -> Column:
        low, high = cell["low"], cell["high"]
        if forward:
            low = shift(low, high, j * 2, a)
            high = shift(high, low, j * 2 + 1, b)
        else:
            high = shift(high, low, j * 2 + 1, b)
            low = shift(low, high, j * 2, a)
        return F.struct(low.alias("low"), high.alias("high"))

    low = F.pmod(x, a)
    start = F.struct(low.alias("low"), ((x - low) / a).cast("long").alias("high"))
    turns = F.array(*[F.lit(j) for j in (range(ROUNDS) if forward else reversed(range(ROUNDS)))])
    return F.aggregate(turns, start, turn, lambda cell: cell["low"] + cell["high"] * a)


def permute(df: DataFrame, column: str, to: str, n: int, seed: int, forward: bool = True) -> DataFrame:
    """Add ``to``: the permuted number of ``column`` (0 to n-1), or with ``forward=False`` the number that was permuted to it.

    The grid has ``spare`` cells beyond n-1.  A number that lands on one is permuted again until it is back below n; it
    cannot meet more than the spare cells on its way, so that many steps are always enough.  At most ``spare`` of the rows,
    under the square root of n, ever walk.
    """
    a, b = _grid(n)
    spare = a * b - n
    once = df.withColumn(to, _network(F.col(column).cast("long"), n, seed, forward))
    if spare <= 0:
        return once

    def step(at: Column, _: Column) -> Column:
        return F.when(at < _long(n), at).otherwise(_network(at, n, seed, forward))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(spare)), F.col(to), step)
    return once.withColumn(to, F.when(F.col(to) < _long(n), F.col(to)).otherwise(walked))


def number_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 of every row and its global number ``row``, gapless from 0.

    Only these narrow columns are sorted.  The position in the input breaks ties, so that a third of all rows may share one
    id and still be split over tasks; rows that tie in all columns are interchangeable.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    narrow = stored(narrow, "rows").withColumn("tie", F.monotonically_increasing_id())
    ordered = stored(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(_long((1 << 33) - 1)).alias("at"),
        ),
        "ordered_rows",
    )
    # one row for each partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ordered.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32", (F.col("start") + F.col("at")).alias("row")
    )


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20240) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard, row, place.

    ``size`` is the text's UTF-8 bytes plus one; a null text has none, and the checksum of no bytes.  Null and repeated
    ids are ordinary rows.  Slots are gapless from 0 in every shard; an empty table gives an empty result.  ``grown_shard``
    is null, as this law moves rows when the count of shards changes.
    """
    rows = number_rows(docs)
    placed = permute(rows, "row", "place", rows.count(), seed)
    shard = F.pmod(F.col("place"), _long(shards))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        ((F.col("place") - shard) / _long(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row", "place",
    )


def rows_at(places: DataFrame, n: int, shards: int = 8, seed: int = 20240) -> DataFrame:
    """The global row number that stands at each (shard, slot) of ``places``, of ``n`` rows in all."""
    at = places.withColumn("place", F.col("slot") * _long(shards) + F.col("shard"))
    return permute(at, "place", "row", n, seed, forward=False)
