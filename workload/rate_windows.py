"""Fixed rate windows, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import requests as R
from shelfmark.operators import rate_limit as RL
from shelfmark.session import work_dir
from workload import adapters as A
from workload.registry import Tables, cte, query

cte(
    "clients",
    """SELECT *, coalesce(nullif(trim(split_part(forwarded_for, ',', 1)), ''), source_ip, 'unknown') AS client FROM requests""",
)


def _windows(minutes: str, source: str = "clients") -> str:
    minute = "(ms + (60000 - ms % 60000) % 60000)"
    unit = f"(({minutes}) * 60000)"
    return f"SELECT *, {minute} + ({unit} - {minute} % {unit}) % {unit} AS reset_ms FROM {source}"


cte("day_windows", _windows("1440"))


@query("client_ids", "SELECT request_id, client FROM clients")
def _(t):
    return A.requests(t).select("request_id", R.client_id(F.col("forwarded_for"), F.col("source_ip")).alias("client"))


@query("window_reset", _windows("15").replace("SELECT *", "SELECT request_id", 1))
def _(t):
    return A.requests(t).select("request_id", R.window_reset_ms(F.col("ts"), 15).alias("reset_ms"))


@query(
    "window_reset_on_boundaries",
    """SELECT event_id AS request_id, ms, ms + (3600000 - ms % 3600000) % 3600000 AS reset_ms
       FROM (SELECT event_id, CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800000 AS ms FROM events)""",
)
def _(t):
    """Times cut to half hours, so that every other one lies exactly on a window boundary."""
    half_hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800) * 1800
    cut = t.events.select(F.col("event_id").alias("request_id"), F.timestamp_seconds(half_hour).alias("at"))
    return cut.select("request_id", F.unix_millis("at").alias("ms"), R.window_reset_ms(F.col("at"), 60).alias("reset_ms"))


@query(
    "minutes_and_milliseconds",
    """SELECT event_id, ms, CAST(ceil(ms / 60000) AS BIGINT) AS minutes, CAST(ceil(ms / 60000) AS BIGINT) * 60000 AS back
       FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events)""",
)
def _(t):
    ms = F.floor(F.col("value") * 1000).cast("bigint")
    df = t.events.select("event_id", ms.alias("ms"), R.ms_to_minutes(ms).alias("minutes"))
    return df.withColumn("back", R.minutes_to_ms(F.col("minutes")))


@query(
    "hashed_clients",
    """SELECT request_id, sha256(client || (reset_ms // 60000 - 1440) || 'pepper') AS client_key FROM day_windows""",
)
def _(t):
    windowed = RL.with_windows(A.requests(t), 2, 1440)
    return windowed.select("request_id", RL.hashed_client(windowed, "pepper").alias("client_key"))


_VERDICT_SQL = """
    SELECT request_id, client, reset_ms, nth, nth <= greatest({limit}, 1) AS allowed, greatest(0, {limit} - nth) AS remaining,
           reset_ms // 1000 AS reset_s,
           CASE WHEN nth > greatest({limit}, 1) THEN greatest(1, CAST(ceil((reset_ms - ms) / 1000) AS BIGINT)) END AS retry_after
    FROM (SELECT *, row_number() OVER (PARTITION BY client, reset_ms, {minutes} ORDER BY ts, request_id) AS nth FROM ({windows}))
"""
_VERDICT_COLUMNS = ["request_id", "client", "reset_ms", "nth", "allowed", "remaining", "reset_s", "retry_after"]


@query("rate_limit", _VERDICT_SQL.format(limit=2, minutes="1440", windows="SELECT * FROM day_windows"))
def _(t):
    return RL.rate_limited(A.requests(t), 2, 1440).select(*_VERDICT_COLUMNS)


@query("rate_limit_zero", _VERDICT_SQL.format(limit=0, minutes="1440", windows="SELECT * FROM day_windows"))
def _(t):
    return RL.rate_limited(A.requests(t), 0, 1440).select(*_VERDICT_COLUMNS)


# Small limits, so that the test data reaches them; the shape is that of the real tiers.
_TIERS = {"public": (1, 60), "registered": (2, 60), "paid": (3, 1440), "private": (6, 1440)}


@query(
    "rate_limit_by_tier",
    _VERDICT_SQL.format(
        limit="tier_limit",
        minutes="minutes",
        windows=_windows(
            "minutes",
            """(SELECT *, CASE tier WHEN 'public' THEN 1 WHEN 'registered' THEN 2 WHEN 'paid' THEN 3 ELSE 6 END AS tier_limit,
                       CASE WHEN tier IN ('public', 'registered') THEN 60 ELSE 1440 END AS minutes FROM clients)""",
        ),
    ),
)
def _(t):
    limited = RL.with_tier_limits(A.requests(t), RL.tier_table(t.spark, _TIERS))
    return RL.rate_limited(limited).select(*_VERDICT_COLUMNS)


@query(
    "tier_limits",
    """SELECT tier, CASE tier WHEN 'public' THEN 50 WHEN 'registered' THEN 100 WHEN 'paid' THEN 3000 ELSE 6000 END AS "limit",
              CASE WHEN tier IN ('public', 'registered') THEN 60 ELSE 1440 END AS window_minutes, count(*) AS requests
       FROM requests GROUP BY ALL""",
)
def _(t):
    limited = RL.with_tier_limits(A.requests(t), RL.tier_table(t.spark))
    return limited.groupBy("tier", "limit", "window_minutes").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "client_stats",
    "SELECT reset_ms, count(DISTINCT client) AS clients, count(*) AS requests FROM day_windows GROUP BY reset_ms",
)
def _(t):
    return RL.client_stats(RL.with_windows(A.requests(t), 2, 1440))


# --- streams ------------------------------------------------------------------------------------


class _Arriving(Tables):
    """The same tables, with events as a stream of files."""

    def __getattr__(self, name):
        schema = self.spark.read.parquet(self.path(name)).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def _arriving(t: Tables) -> _Arriving:
    return _Arriving(t.spark, t.sf_dir)


class _Landed(Tables):
    """Tables as streams of the files that have come into a folder."""

    def __getattr__(self, name):
        path = f"{self.sf_dir}/{name}"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(path)


def _in_parts(t: Tables, root: str, key, parts: int = 3):
    """Events that come in several parts, dealt by a key without regard to time; a stream is to be run after each."""
    for part in range(parts):
        some = t.events.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        some.write.mode("append").parquet(f"{root}/arriving/events")
        yield _Landed(t.spark, f"{root}/arriving")


@query("rate_limit_stream", _VERDICT_SQL.format(limit=2, minutes="1440", windows="SELECT * FROM day_windows"))
def _(t):
    from shelfmark.streaming.rate_limit import RateLimitStream

    root = work_dir(t.spark, "rate-limit")
    stream = RateLimitStream(root, 2, 1440)
    # whole windows to a part, in mixed order: verdicts over parts of a window follow their arrival, which SQL does not know
    for landed in _in_parts(t, root, R.window_reset_ms(F.col("ts"), 1440)):
        stream.start(A.requests(landed), f"{root}/checkpoint").awaitTermination()
    return stream.verdicts(t.spark).select(*_VERDICT_COLUMNS)


@query(
    "metric_stream",
    """SELECT event_type AS metric, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS period, count(*) AS samples,
              round(sum(value), 4) AS sum_value, max(value) AS max_value, min(value) AS min_value, true AS p99_within FROM events GROUP BY 1, 2""",
)
def _(t):
    """Samples in three parts in mixed order; the sketched p99 lies within the sketch's error of rank 0.99."""
    from shelfmark.operators.logs import period_start
    from shelfmark.streaming.metrics import MetricStream

    root = work_dir(t.spark, "metrics")
    stream = MetricStream(root, 3600, compact_after=2)
    for landed in _in_parts(t, root, F.col("event_id")):
        stream.start(A.metrics(landed), f"{root}/checkpoint").awaitTermination()
    series = stream.series(t.spark)
    counts = A.metrics(t).where("value IS NOT NULL").groupBy("metric", period_start(F.col("ts"), 3600).alias("period"), "value")
    met = series.join(counts.agg(F.count(F.lit(1)).alias("n")), ["metric", "period"], "left")
    below = F.sum(F.when(F.col("value") < F.col("p99_value"), F.col("n")).otherwise(0))
    upto = F.sum(F.when(F.col("value") <= F.col("p99_value"), F.col("n")).otherwise(0))
    total = F.sum("n")
    within = total.isNull() | ((below <= total * (0.99 + 0.0165)) & (upto >= total * (0.99 - 0.0165)))
    grouped = met.groupBy("metric", "period", "samples", "sum_value", "max_value", "min_value").agg(within.alias("p99_within"))
    return grouped.select(
        "metric", F.unix_timestamp("period").alias("period"), "samples", F.round("sum_value", 4).alias("sum_value"),
        "max_value", "min_value", "p99_within",
    )


@query(
    "alarm_stream",
    """SELECT period, metric, round(statistic, 4) AS statistic FROM (
         SELECT *, lag(period) OVER (PARTITION BY metric ORDER BY period) AS before FROM (
           SELECT event_type AS metric, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS period, avg(value) AS statistic FROM events GROUP BY 1, 2
           HAVING avg(value) > 5)) WHERE before = period - 300""",
)
def _(t):
    """Alarms of every metric over three parts in mixed order: late samples fire and clear."""
    from shelfmark.streaming.metrics import AlarmStream

    root = work_dir(t.spark, "alarms")
    stream = AlarmStream(root, "avg", 5.0, 300, consecutive=2)
    for landed in _in_parts(t, root, F.col("event_id")):
        stream.start(A.metrics(landed), f"{root}/checkpoint").awaitTermination()
    return stream.alarms(t.spark).select(F.unix_timestamp("period").alias("period"), "metric", F.round("statistic", 4).alias("statistic"))


@query(
    "log_line_stream",
    """SELECT log_id, split_part(rest, ' | ', 2) AS endpoint, split_part(rest, ' | ', 3) AS result FROM tagged WHERE tag = 'CACHE'""",
)
def _(t):
    from shelfmark.streaming.log_lines import start_parsing

    root = work_dir(t.spark, "log-lines")
    start_parsing(A.logs(_arriving(t)), f"{root}/lines", f"{root}/checkpoint").awaitTermination()
    lines = t.spark.read.parquet(f"{root}/lines")
    return lines.where(F.col("cache").isNotNull()).select("log_id", "cache.endpoint", "cache.result")
