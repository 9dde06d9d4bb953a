"""Saved log reports as functions over log tables.

``logs`` has ``log_id, ts, log_stream, message`` and, where a report needs it, ``duration``;
``reports`` has ``type, duration, init_duration, memory_size, max_memory_used``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.logs import CACHE_FIELDS, RESPONSE_FIELDS, like, number, parse_glob, parse_regex
from shelfmark.operators.ranking import with_quantiles

MIB = 1024 * 1024

# Fixed patterns of the saved reports.
TOOL = r"tool[:\s]+([^\s,]+)"
BUCKET = r"bucket[:\s]+([^\s,]+)"
NAMESPACE = r"namespace[:\s]+([^\s,]+)"
ORG = r"user/org[:\s]+([^\s,]+)"
DURATION = r"duration[:\s]+(\d+)"
BROWN_OUT = ["brown-out", "partial data", "source failed", "bucket.*skipped", "user.*org.*failed"]
ERROR_CODES = r"(TEMPLATE_NOT_FOUND|INVALID_INPUT|BUCKET_ACCESS_DENIED|GITHUB_RATE_LIMIT|S3_ERROR|DYNAMODB_ERROR)"
BUCKET_ISSUES = r"(?i)(access denied|not found|missing tag|Allow=false|no IndexPriority)"
NAMESPACE_ISSUES = r"(?i)(no IndexPriority|empty IndexPriority|namespace not found|invalid namespace)"
SIDECAR_ISSUES = r"(?i)(missing sidecar|invalid JSON|missing required field)"
VALIDATION_ISSUES = r"(?i)(missing required|invalid format|out of range|unknown parameter)"

#: Upper ends of the duration bins in ms; bins from 1000 on include both ends.
BIN_EDGES = [50, 100, 250, 500, 750, 1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000]


def count_rows(name: str = "requests") -> Column:
    return F.count(F.lit(1)).alias(name)


# --- views --------------------------------------------------------------------------------------


def recent(logs: DataFrame, n: int | None) -> DataFrame:
    """The newest ``n`` lines; reports that parse and filter afterwards are "of the last n lines"."""
    return logs if n is None else logs.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(n)


def _tagged_lines(logs: DataFrame, tag: str, fields: list[str], last_n: int | None, keep: list[str]) -> DataFrame:
    """Lines of one tag; the text test spares other lines the pattern."""
    lines = recent(logs, last_n).where(F.col("message").contains(f"[{tag}] "))
    return parse_glob(lines, fields, keep).where(F.col("logging_type") == tag)


def response_lines(logs: DataFrame, last_n: int | None = None) -> DataFrame:
    parsed = _tagged_lines(logs, "RESPONSE", RESPONSE_FIELDS, last_n, ["log_id", "ts"])
    return parsed.withColumn("exec_ms", F.col("exec_time").try_cast("bigint"))


def cache_lines(logs: DataFrame, last_n: int | None = None) -> DataFrame:
    parsed = _tagged_lines(logs, "CACHE", CACHE_FIELDS, last_n, ["log_id", "ts"])
    return parsed.withColumn("exec_ms", F.col("exec_time").try_cast("bigint"))


def problem_lines(logs: DataFrame, last_n: int | None = None) -> DataFrame:
    """Error and warning lines, and timeouts, among the newest lines."""
    lines = parse_glob(recent(logs, last_n), ["logging_message"], ["log_id", "ts", "log_stream", "message"])
    timed_out = F.col("message").contains("Task timed out")
    return lines.where(F.coalesce(F.col("logging_type").isin("ERROR", "WARN"), F.lit(False)) | timed_out)


def cold_start_lines(logs: DataFrame, last_n: int | None = None) -> DataFrame:
    return _tagged_lines(logs, "COLDSTART", ["ms"], last_n, ["log_id", "ts", "log_stream"])


def rate_limit_violations(logs: DataFrame, access: DataFrame, last_n: int | None = None) -> DataFrame:
    """Limit violations of both log groups, or the newest of them."""
    from_logs = logs.where(like(F.col("message"), "rate limit", "too many requests")).select(
        F.col("log_id").alias("request_id"), "ts", "message", F.lit(None).cast("string").alias("ip"),
        F.lit(None).cast("int").alias("status"),
    )
    from_access = access.where(F.col("status") == 429).select(
        "request_id", "ts", F.lit(None).cast("string").alias("message"), "ip", "status"
    )
    both = from_logs.unionByName(from_access)
    if last_n is None:
        return both
    return both.orderBy(F.col("ts").desc(), F.col("request_id").desc(), F.col("status").asc_nulls_first()).limit(last_n)


# --- grouped statistics -------------------------------------------------------------------------


def _stats(value: str) -> list[Column]:
    return [
        count_rows(),
        F.min(value).alias("min_ms"),
        F.ceil(F.avg(value)).cast("bigint").alias("avg_ms"),
        F.max(value).alias("max_ms"),
    ]


def stats_by(df: DataFrame, *keys: str, value: str = "exec_ms") -> DataFrame:
    """Requests, minimum, rounded-up average and maximum per key."""
    return df.groupBy(*keys).agg(*_stats(value))


def stats_by_sets(df: DataFrame, key_sets: Sequence[Sequence[str]], value: str = "exec_ms") -> DataFrame:
    """:func:`stats_by` for several key sets in one scan; ``grouping_id`` tells the sets apart."""
    columns = list(dict.fromkeys(k for keys in key_sets for k in keys))
    return df.groupingSets([tuple(keys) for keys in key_sets], *columns).agg(
        F.grouping_id().alias("grouping_id"), *_stats(value)
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(count_rows())


# --- invocation reports -------------------------------------------------------------------------


def _reports(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("type") == "REPORT")


def _bins(strict: bool) -> list[tuple[str, Column]]:
    d = F.col("duration")
    bins = [(f"under_{BIN_EDGES[0]}", d < BIN_EDGES[0])]
    for low, high in zip(BIN_EDGES, BIN_EDGES[1:]):
        closed = high > 1000 and (not strict or high == BIN_EDGES[-1])
        bins.append((f"from_{low}_to_{high}", (d >= low) & ((d <= high) if closed else (d < high))))
    return bins + [(f"over_{BIN_EDGES[-1]}", d > BIN_EDGES[-1])]


def duration_histogram(reports: DataFrame, strict_bins: bool = False) -> DataFrame:
    """Sixteen duration bins with minimum, average and maximum.

    The bins from 1000 ms on share their ends, so exactly 2000 counts twice; ``strict_bins`` counts it once.
    """
    counts = [F.count_if(condition).alias(name) for name, condition in _bins(strict_bins)]
    return _reports(reports).agg(
        F.min("duration").alias("min_duration"),
        F.avg("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        *counts,
    )


def memory_usage(reports: DataFrame) -> DataFrame:
    used, size = F.col("max_memory_used") / MIB, F.col("memory_size") / MIB
    return (
        _reports(reports)
        .agg(
            F.max(size).alias("provisioned_mb"),
            F.min(used).alias("smallest_request_mb"),
            F.avg(used).alias("avg_used_mb"),
            F.max(used).alias("max_used_mb"),
        )
        .withColumn("over_provisioned_mb", F.col("provisioned_mb") - F.col("max_used_mb"))
    )


def memory_utilization(reports: DataFrame) -> DataFrame:
    percent = F.try_divide(F.col("max_memory_used"), F.col("memory_size")) * 100
    return _reports(reports).agg(
        count_rows("invocations"),
        F.avg("max_memory_used").alias("avg_memory_used"),
        F.max("max_memory_used").alias("max_memory_used"),
        F.avg("memory_size").alias("configured_memory"),
        F.avg(percent).alias("avg_memory_utilization"),
        F.max(percent).alias("max_memory_utilization"),
    )


def cold_starts(reports: DataFrame) -> DataFrame:
    """Initialisation times; the minimum is that of the whole duration."""
    return _reports(reports).agg(
        F.min("duration").alias("min_duration"),
        F.avg("init_duration").alias("avg_init"),
        F.max("init_duration").alias("max_init"),
        F.count("init_duration").alias("num"),
    )


def cold_start_rate(reports: DataFrame) -> DataFrame:
    rows = _reports(reports)
    totals = rows.agg(
        count_rows("invocations"),
        F.count_if(F.col("init_duration") > 0).alias("cold_starts"),
        F.avg("duration").alias("avg_duration"),
        F.avg("init_duration").alias("avg_init_duration"),
        F.max("init_duration").alias("max_init_duration"),
    ).withColumn("cold_start_rate", F.try_divide(F.col("cold_starts"), F.col("invocations")) * 100)
    return with_quantiles(totals, rows, [], "duration", {"p95_duration": 0.95})


# --- free-text reports --------------------------------------------------------------------------


def cache_hit_rate(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    parsed = logs.where(like(m, "cache")).select(
        parse_regex(m, r"(?i)cache[:\s]+(hit|miss)").alias("cache_status"),
        number(m, DURATION).alias("duration"),
        parse_regex(m, TOOL).alias("tool"),
    )
    return (
        parsed.groupBy("tool")
        .agg(
            count_rows("total_requests"),
            F.count_if(F.col("cache_status") == "hit").alias("cache_hits"),
            F.count_if(F.col("cache_status") == "miss").alias("cache_misses"),
            F.avg("duration").alias("avg_duration"),
            F.max("duration").alias("max_duration"),
        )
        .withColumn("hit_rate", F.try_divide(F.col("cache_hits"), F.col("total_requests")) * 100)
        .orderBy(F.col("hit_rate").desc(), "tool")
    )


def latency_by_tool(logs: DataFrame, approximate: bool = False) -> DataFrame:
    """Latency per tool; exact percentiles by ranks over value counts, or sketches if ``approximate``."""
    m = F.col("message")
    parsed = logs.where(m.rlike(r"tool[:\s]+")).select(
        parse_regex(m, TOOL).alias("tool"), "duration", number(m, DURATION).alias("request_duration")
    )
    measures = [
        count_rows("request_count"),
        F.avg("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        F.avg("request_duration").alias("avg_request_duration"),
        F.max("request_duration").alias("max_request_duration"),
    ]
    if approximate:
        return parsed.groupBy("tool").agg(
            *measures,
            F.percentile_approx("duration", 0.95).alias("p95_duration"),
            F.percentile_approx("duration", 0.99).alias("p99_duration"),
        )
    totals = parsed.groupBy("tool").agg(*measures)
    return with_quantiles(totals, parsed, ["tool"], "duration", {"p95_duration": 0.95, "p99_duration": 0.99})


def errors_by_type(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    code = F.coalesce(
        parse_regex(m, ERROR_CODES), parse_regex(m, r"(?i)error[:\s]+([^:]+):"), F.lit("Unknown")
    )
    lines = logs.where(like(m, "error", "exception", "failed"))
    return lines.groupBy(code.alias("error_type")).agg(count_rows("error_count"))


def brown_outs(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    return (
        logs.where(like(m, *BROWN_OUT))
        .groupBy(parse_regex(m, BUCKET).alias("failed_bucket"), parse_regex(m, ORG).alias("failed_org"))
        .agg(count_rows("failure_count"))
    )


def _issues(logs: DataFrame, condition: Column, keys: dict[str, str], name: str = "issue_count") -> DataFrame:
    m = F.col("message")
    columns = [parse_regex(m, pattern).alias(key) for key, pattern in keys.items()]
    return logs.where(condition).groupBy(*columns).agg(count_rows(name))


def bucket_issues(logs: DataFrame, access_tag: str | None = None) -> DataFrame:
    """Access problems per bucket; ``access_tag`` is the name of the tag that grants access, if any."""
    m = F.col("message")
    hints = ["access denied", "not found", "missing tag", "IndexPriority"]
    if access_tag:
        hints.append(access_tag)
    return _issues(logs, like(m, "bucket") & like(m, *hints), {"bucket": BUCKET, "issue": BUCKET_ISSUES})


def namespace_issues(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    condition = like(m, "namespace") & like(m, "error", "warning", "IndexPriority")
    return _issues(logs, condition, {"bucket": BUCKET, "namespace": NAMESPACE, "issue": NAMESPACE_ISSUES})


def sidecar_issues(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    keys = {"starter": r"starter[:\s]+([^\s,]+)", "bucket": BUCKET, "issue": SIDECAR_ISSUES}
    return _issues(logs, like(m, "sidecar") & like(m, "missing", "invalid", "error"), keys)


def validation_errors(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    keys = {"tool": TOOL, "parameter": r"parameter[:\s]+([^\s,]+)", "validation_error": VALIDATION_ISSUES}
    return _issues(logs, like(m, "validation") & like(m, "error", "invalid"), keys, "error_count")


def quota_floor(logs: DataFrame) -> DataFrame:
    """Lowest remaining hosting-API quota per organisation."""
    m = F.col("message")
    lines = logs.where(like(m, "github") & like(m, "rate limit", "X-RateLimit"))
    return lines.groupBy(parse_regex(m, ORG).alias("user_org")).agg(
        F.min(number(m, r"X-RateLimit-Remaining[:\s]+(\d+)")).alias("min_remaining"),
        F.max(number(m, r"X-RateLimit-Limit[:\s]+(\d+)")).alias("rate_limit"),
    )


def discovery_performance(logs: DataFrame) -> DataFrame:
    m = F.col("message")
    lines = logs.where(like(m, "list_templates", "template discovery"))
    return lines.groupBy(parse_regex(m, BUCKET).alias("bucket"), parse_regex(m, NAMESPACE).alias("namespace")).agg(
        count_rows("discovery_count"),
        F.avg("duration").alias("avg_duration"),
        F.sum(number(m, r"templates found[:\s]+(\d+)")).alias("total_templates"),
    )


def search_query_stats(logs: DataFrame, top: int | None = None) -> DataFrame:
    """Searches, results and durations by query text; ``top`` keeps the most frequent ones."""
    m = F.col("message")
    lines = logs.where(like(m, "search_documentation"))
    found = lines.groupBy(parse_regex(m, r"query[:\s]+([^,]+)").alias("search_query")).agg(
        count_rows("search_count"),
        F.avg(number(m, r"results[:\s]+(\d+)")).alias("avg_results"),
        F.avg(number(m, DURATION)).alias("avg_duration"),
        F.max(number(m, DURATION)).alias("max_duration"),
    )
    return found if top is None else found.orderBy(F.col("search_count").desc(), "search_query").limit(top)


def access_by_tool_status(access: DataFrame) -> DataFrame:
    tool = parse_regex(F.col("path"), r"/mcp/([^/?]+)")
    return access.groupBy(tool.alias("tool"), "status").agg(
        count_rows("request_count"),
        F.avg("response_length").alias("avg_response_size"),
        F.count_if(F.col("status") >= 400).alias("error_count"),
        F.count_if(F.col("status") == 429).alias("rate_limit_count"),
    )


# --- metrics ------------------------------------------------------------------------------------


def metric_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("samples"),
        F.sum("value").alias("sum_value"),
        F.avg("value").alias("avg_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
    ]


def period_start(ts: Column, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def metric_series(metrics: DataFrame, seconds: int = 300, p99: bool = True) -> DataFrame:
    """Samples, sum, average, extremes and p99 per metric and period."""
    keyed = metrics.withColumn("period", period_start(F.col("ts"), seconds))
    series = keyed.groupBy("metric", "period").agg(*metric_aggregates())
    return with_quantiles(series, keyed, ["metric", "period"], "value", {"p99_value": 0.99}) if p99 else series


def alarms(
    metrics: DataFrame, metric: str, statistic: str, threshold: float, seconds: int, consecutive: int = 1
) -> DataFrame:
    """Periods in which a statistic has exceeded the threshold ``consecutive`` times in a row.

    Periods without samples do not breach.
    """
    function = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[statistic]
    series = (
        metrics.where(F.col("metric") == metric)
        .groupBy(period_start(F.col("ts"), seconds).alias("period"))
        .agg(function("value").alias("statistic"))
        .where(F.col("statistic") > threshold)
    )
    # A breach also counts for the periods after it; a period hit by all of them is in alarm.
    hits = series.select(
        F.explode(F.sequence(F.lit(0), F.lit(consecutive - 1))).alias("lag"),
        F.unix_timestamp("period").alias("start"),
        "statistic",
    ).withColumn("start", F.col("start") + F.col("lag") * seconds)
    return (
        hits.groupBy("start")
        .agg(F.count(F.lit(1)).alias("breaches"), F.max(F.when(F.col("lag") == 0, F.col("statistic"))).alias("statistic"))
        .where(F.col("breaches") == consecutive)
        .select(F.timestamp_seconds("start").alias("period"), F.lit(metric).alias("metric"), "statistic")
    )


