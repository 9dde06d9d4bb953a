"""Ranking, first-wins and exact quantiles that stay distributed when one key holds most rows.

``first_wins``/``top_k`` filter a ``row_number`` by a constant, for which Spark adds a group
limit *before* the shuffle: each task forwards at most ``k`` rows of a key, however hot it is.
``numbered`` numbers *every* row of a group, and ``exact_quantiles`` ranks every value, over the ranges of one
distributed sort: a key may span any number of ranges, and small sums over the ranges give what came before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import stored

#: Default of spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000
SALTS = 64


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the given order; the order must be total within a key."""
    return top_k(df, keys, order, 1).drop("_rank")


def last_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The last row of every key in the given ascending order."""
    return first_wins(df, keys, [c.desc() for c in _columns(order)])


def top_k(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], k: int, name: str = "_rank"
) -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1 in column ``name``.

    Beyond the size up to which Spark limits groups before the shuffle, a first cut per key and salt
    takes its place: the best ``k`` of a key are among the best ``k`` of its parts.
    """
    if k > GROUP_LIMIT:
        hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
        part = Window.partitionBy(*_columns(keys), F.col("_salt")).orderBy(*_columns(order))
        df = salted.withColumn("_cut", F.row_number().over(part)).where(F.col("_cut") <= k).drop("_salt", "_cut")
    window = Window.partitionBy(*_columns(keys)).orderBy(*_columns(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows, stored, with ``_range``: the number of their range of a sort.  A key's rows lie in ranges that follow each other."""
    return stored(df.repartitionByRange(*_columns(order)).withColumn("_range", F.spark_partition_id()), "ranges")


def _before(ranged: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """``keys, _range, _before``: what earlier ranges hold of a key that goes on.

    A range has at most one key that began before it, so there are fewer rows than ranges.
    """
    sums = ranged.groupBy(*keys, "_range").agg(weight.alias("_sum"))
    earlier = Window.partitionBy(*_columns(keys)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "_range", F.sum("_sum").over(earlier).alias("_before")).where(F.col("_before").isNotNull())


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows of every key from 1 in an order that is total within a key.

    Rows are sorted into ranges of key and order, so a key with most of the rows, or a burst of them at one moment, is split
    wherever the order splits it.  Each range is numbered by itself, and a key that goes on adds what earlier ranges hold.
    """
    ranged = _ranges(df, [*keys, *order])
    local = F.row_number().over(Window.partitionBy(*_columns([*keys, "_range"])).orderBy(*_columns(order)))
    before = _before(ranged, keys, F.count(F.lit(1)))
    joined = _null_safe_join(ranged.withColumn("_local", local), before, [*keys, "_range"], "left")
    return joined.withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop(
        "_range", "_local", "_before"
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, one column per entry of ``probabilities``.

    Equal values collapse to counts first, in partial sums.  The counts are sorted into ranges of key and value, so that no
    task sorts all values of a key; running sums inside a range and sums of earlier ranges give each value its
    ranks.  The rows are read once.  Nulls are ignored, as in an aggregate.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranged = _ranges(counts, [*keys, "_v"])
    before = _before(ranged, keys, F.sum("_c"))
    totals = ranged.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    in_range = Window.partitionBy(*_columns([*keys, "_range"])).orderBy("_v")
    running = F.sum("_c").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = _null_safe_join(ranged.withColumn("_run", running), before, [*keys, "_range"], "left")
    ranked = _null_safe_join(ranked, totals, keys)
    # Value "_v" covers the zero-based ranks [lo, hi).
    hi = F.coalesce("_before", F.lit(0)) + F.col("_run")
    lo = hi - F.col("_c")
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_n") - 1)
        for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((lo <= rank) & (rank < hi), F.col("_v"))).alias(f"_{name}_{end}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_f"))
    picked = ranked.groupBy(*keys).agg(*picks)
    result = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
        for n in probabilities
    ]
    return picked.select(*keys, *result)


def with_quantiles(
    aggregated: DataFrame, df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """``aggregated`` (one row per key, keys may be null) with exact quantile columns added.

    Without keys both sides are one row, joined on a constant.
    """
    if keys:
        return _null_safe_join(aggregated, exact_quantiles(df, keys, value, probabilities), keys, "left")
    quantiles = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probabilities)
    return aggregated.withColumn("_all", F.lit(0)).join(quantiles, "_all", "left").drop("_all")
