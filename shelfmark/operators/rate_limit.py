"""Fixed-window rate accounting over request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.requests import MINUTE_MS, client_id, client_key, window_reset_ms
from shelfmark.operators.ranking import numbered

# Requests per window and window length in minutes.
TIERS = {"public": (50, 60), "registered": (100, 60), "paid": (3000, 1440), "private": (6000, 1440)}
#: What requests are counted by.
WINDOW_KEYS = ["client", "reset_ms", "window_minutes"]
#: How long a closed window's state is kept.
STATE_GRACE_MS = 5 * MINUTE_MS


def tier_table(spark: SparkSession, tiers: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    rows = [(name, limit, minutes) for name, (limit, minutes) in (tiers or TIERS).items()]
    return spark.createDataFrame(rows, "tier string, limit int, window_minutes int")


def with_tier_limits(requests: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds ``limit`` and ``window_minutes`` of each request's tier."""
    return requests.join(tiers, "tier")


def with_windows(
    requests: DataFrame, limit: int | None = None, window_minutes: int | None = None, offset_minutes: int = 0
) -> DataFrame:
    """Adds ``client, limit, window_minutes, reset_ms``; limits may already be columns."""
    if limit is not None:
        requests = requests.withColumn("limit", F.lit(limit))
    if window_minutes is not None:
        requests = requests.withColumn("window_minutes", F.lit(window_minutes))
    if "client" not in requests.columns:
        requests = requests.withColumn("client", client_id(F.col("forwarded_for"), F.col("source_ip")))
    return requests.withColumn("reset_ms", window_reset_ms(F.col("ts"), F.col("window_minutes"), offset_minutes))


def numbered_in_window(windowed: DataFrame) -> DataFrame:
    """Adds ``nth``: the position of a request among those of its client and window.

    Windows of different length are different windows, also when they end together.
    """
    return numbered(windowed, WINDOW_KEYS, ["ts", "request_id"], "nth")


def verdicts(numbered: DataFrame) -> DataFrame:
    """Adds ``allowed, remaining, reset_s, retry_after`` to numbered requests.

    The first request of a window passes even under a limit of zero.
    """
    nth, limit = F.col("nth"), F.col("limit")
    allowed = nth <= F.greatest(limit, F.lit(1))
    wait = F.ceil((F.col("reset_ms") - F.unix_millis("ts")) / F.lit(1000)).cast("bigint")
    return (
        numbered.withColumn("allowed", allowed)
        .withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), limit - nth))
        .withColumn("reset_s", F.floor(F.col("reset_ms") / 1000).cast("bigint"))
        .withColumn("retry_after", F.when(~F.col("allowed"), F.greatest(F.lit(1).cast("bigint"), wait)))
    )


def rate_limited(
    requests: DataFrame, limit: int | None = None, window_minutes: int | None = None, offset_minutes: int = 0
) -> DataFrame:
    """Verdict for every request: the first ``limit`` of a client's window pass."""
    return verdicts(numbered_in_window(with_windows(requests, limit, window_minutes, offset_minutes)))


def hashed_client(df: DataFrame, salt: Column | str) -> Column:
    """Salted client key of the window, as stored instead of the address."""
    start = F.floor(df["reset_ms"] / MINUTE_MS).cast("bigint") - df["window_minutes"]
    return client_key(df["client"], start, F.lit(salt) if isinstance(salt, str) else salt)


def client_stats(windowed: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct clients per window."""
    count = F.approx_count_distinct("client") if approximate else F.count_distinct("client")
    return windowed.groupBy("reset_ms").agg(count.alias("clients"), F.count(F.lit(1)).alias("requests"))
