"""Log reports, metrics and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import logs as LF
from shelfmark.functions.logs import parse_regex
from shelfmark.operators import logs as L
from workload import adapters as A
from workload.registry import cte, query

_RESPONSE = ", ".join(
    f"split_part(rest, ' | ', {i}) AS {name}" for i, name in enumerate(LF.RESPONSE_FIELDS, start=1)
)
_CACHE = ", ".join(f"split_part(rest, ' | ', {i}) AS {name}" for i, name in enumerate(LF.CACHE_FIELDS, start=1))
cte(
    "tagged",
    r"""SELECT *, regexp_extract(message, '^[^\[]*\[(.*?)\] (.*)$', 1) AS tag, regexp_extract(message, '^[^\[]*\[(.*?)\] (.*)$', 2) AS rest
        FROM logs""",
)
cte(
    "response_lines",
    f"""SELECT log_id, tag AS logging_type, {_RESPONSE}, TRY_CAST(split_part(rest, ' | ', 4) AS BIGINT) AS exec_ms
        FROM tagged WHERE tag = 'RESPONSE'""",
)
cte(
    "cache_lines",
    f"""SELECT log_id, tag AS logging_type, {_CACHE}, TRY_CAST(split_part(rest, ' | ', 4) AS BIGINT) AS exec_ms
        FROM tagged WHERE tag = 'CACHE'""",
)


@query("parse_response_lines", "SELECT * FROM response_lines")
def _(t):
    return L.response_lines(A.logs(t)).drop("ts")


@query("parse_cache_lines", "SELECT * FROM cache_lines")
def _(t):
    return L.cache_lines(A.logs(t)).drop("ts")


@query(
    "parse_named_groups",
    r"""SELECT log_id, nullif(regexp_extract(message, 'tool[:\s]+([^\s,]+)', 1), '') AS tool,
               nullif(regexp_extract(message, 'bucket[:\s]+([^\s,]+)', 1), '') AS bucket,
               TRY_CAST(nullif(regexp_extract(message, 'duration[:\s]+(\d+)', 1), '') AS BIGINT) AS duration FROM logs""",
)
def _(t):
    m = F.col("message")
    return A.logs(t).select(
        "log_id",
        LF.parse_regex(m, L.TOOL).alias("tool"),
        LF.parse_regex(m, L.BUCKET).alias("bucket"),
        LF.number(m, L.DURATION).alias("duration"),
    )


@query(
    "union_log_groups",
    """SELECT log_id AS id, 'service' AS log_group FROM logs WHERE regexp_matches(message, '(?i)rate limit')
       UNION ALL SELECT request_id, 'gateway' FROM access_log WHERE status = 429""",
)
def _(t):
    from shelfmark.sources.logs import union_groups

    both = union_groups({
        "service": A.logs(t).select(F.col("log_id").alias("id"), "message"),
        "gateway": A.access_log(t).select(F.col("request_id").alias("id"), "status"),
    })
    wanted = LF.like(F.col("message"), "rate limit") | (F.col("status") == 429)
    return both.where(wanted).select("id", "log_group")


@query(
    "rate_limit_violations",
    """SELECT request_id, message, ip, status FROM (
         SELECT log_id AS request_id, ts, message, NULL AS ip, CAST(NULL AS INTEGER) AS status FROM logs
         WHERE regexp_matches(message, '(?i)rate limit') OR regexp_matches(message, '(?i)too many requests')
         UNION ALL SELECT request_id, ts, NULL, ip, status FROM access_log WHERE status = 429)""",
)
def _(t):
    return L.rate_limit_violations(A.logs(t), A.access_log(t)).drop("ts")


_RECENT = "(SELECT * FROM tagged ORDER BY ts DESC, log_id DESC LIMIT {n})"


@query(
    "recent_responses",
    f"SELECT log_id, {_RESPONSE} FROM {_RECENT.format(n=500)} WHERE tag = 'RESPONSE'",
)
def _(t):
    return L.response_lines(A.logs(t), 500).drop("ts", "exec_ms", "logging_type")


@query(
    "recent_problems",
    f"""SELECT log_id, log_stream, tag AS logging_type, rest AS logging_message FROM tagged
        WHERE tag IN ('ERROR', 'WARN') OR contains(message, 'Task timed out')""",
)
def _(t):
    return L.problem_lines(A.logs(t)).drop("ts", "message")


@query(
    "recent_cold_starts",
    f"SELECT log_id, log_stream, rest AS ms FROM tagged WHERE tag = 'COLDSTART'",
)
def _(t):
    return L.cold_start_lines(A.logs(t)).drop("ts", "logging_type")


def _stats_query(name: str, lines, table: str, *keys: str) -> None:
    columns = ", ".join(keys)
    query(
        name,
        f"""SELECT {columns}, count(*) AS requests, min(exec_ms) AS min_ms, CAST(ceil(avg(exec_ms)) AS BIGINT) AS avg_ms,
                   max(exec_ms) AS max_ms FROM {table} GROUP BY {columns}""",
    )(lambda t: L.stats_by(lines(A.logs(t)), *keys))


_stats_query("stats_by_endpoint", L.cache_lines, "cache_lines", "endpoint")
_stats_query("stats_by_endpoint_result", L.cache_lines, "cache_lines", "endpoint", "result")
_stats_query("stats_by_result", L.cache_lines, "cache_lines", "result")
_stats_query("stats_by_resource", L.response_lines, "response_lines", "resource")
_stats_query("stats_by_path", L.response_lines, "response_lines", "path_log")
_stats_query("stats_by_resource_query_keys", L.response_lines, "response_lines", "resource", "query_keys")
_stats_query("stats_by_path_query", L.response_lines, "response_lines", "path_log", "query_log")


@query(
    "stats_of_last_500_lines",
    f"""SELECT split_part(rest, ' | ', 2) AS endpoint, count(*) AS requests, min(ms) AS min_ms,
               CAST(ceil(avg(ms)) AS BIGINT) AS avg_ms, max(ms) AS max_ms
        FROM (SELECT *, TRY_CAST(split_part(rest, ' | ', 4) AS BIGINT) AS ms FROM {_RECENT.format(n=500)} WHERE tag = 'CACHE')
        GROUP BY 1""",
)
def _(t):
    return L.stats_by(L.cache_lines(A.logs(t), 500), "endpoint")


@query(
    "stats_grouping_sets",
    """SELECT endpoint, result, CAST(grouping_id(endpoint, result) AS BIGINT) AS grouping_id, count(*) AS requests, min(exec_ms) AS min_ms,
              CAST(ceil(avg(exec_ms)) AS BIGINT) AS avg_ms, max(exec_ms) AS max_ms
       FROM cache_lines GROUP BY GROUPING SETS ((endpoint), (endpoint, result), (result))""",
)
def _(t):
    return L.stats_by_sets(L.cache_lines(A.logs(t)), [["endpoint"], ["endpoint", "result"], ["result"]])


def _count_query(name: str, lines, table: str, key: str) -> None:
    query(name, f"SELECT {key}, count(*) AS requests FROM {table} GROUP BY {key}")(
        lambda t: L.count_by(lines(A.logs(t)), key)
    )


_count_query("count_by_result", L.cache_lines, "cache_lines", "result")
_count_query("count_by_resource", L.response_lines, "response_lines", "resource")
_count_query("count_by_key", L.response_lines, "response_lines", "key")


@query(
    "order_by_requests",
    "SELECT endpoint, count(*) AS requests FROM cache_lines GROUP BY endpoint ORDER BY requests DESC, endpoint",
)
def _(t):
    counted = L.count_by(L.cache_lines(A.logs(t)), "endpoint")
    return counted.orderBy(F.col("requests").desc(), "endpoint")


# --- reports ------------------------------------------------------------------------------------

_EDGES = L.BIN_EDGES


def _bin_sql(strict: bool) -> str:
    bins = [f"count(*) FILTER (duration < {_EDGES[0]}) AS under_{_EDGES[0]}"]
    for low, high in zip(_EDGES, _EDGES[1:]):
        op = "<=" if high > 1000 and (not strict or high == 10000) else "<"
        bins.append(f"count(*) FILTER (duration >= {low} AND duration {op} {high}) AS from_{low}_to_{high}")
    bins.append(f"count(*) FILTER (duration > {_EDGES[-1]}) AS over_{_EDGES[-1]}")
    return f"""SELECT min(duration) AS min_duration, round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration,
        {', '.join(bins)} FROM reports WHERE type = 'REPORT'"""


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("duration_histogram", _bin_sql(False))
def _(t):
    return _rounded(L.duration_histogram(A.reports(t)), "avg_duration")


@query("duration_histogram_strict", _bin_sql(True))
def _(t):
    return _rounded(L.duration_histogram(A.reports(t), strict_bins=True), "avg_duration")


@query(
    "memory_usage",
    """SELECT max(memory_size / 1048576) AS provisioned_mb, min(max_memory_used / 1048576) AS smallest_request_mb,
              round(avg(max_memory_used / 1048576), 6) AS avg_used_mb, max(max_memory_used / 1048576) AS max_used_mb,
              max(memory_size / 1048576) - max(max_memory_used / 1048576) AS over_provisioned_mb
       FROM reports WHERE type = 'REPORT'""",
)
def _(t):
    return _rounded(L.memory_usage(A.reports(t)), "avg_used_mb")


@query(
    "memory_utilization",
    """SELECT count(*) AS invocations, round(avg(max_memory_used), 4) AS avg_memory_used, max(max_memory_used) AS max_memory_used,
              round(avg(memory_size), 4) AS configured_memory,
              round(avg(max_memory_used / memory_size * 100), 6) AS avg_memory_utilization,
              round(max(max_memory_used / memory_size * 100), 6) AS max_memory_utilization
       FROM reports WHERE type = 'REPORT'""",
)
def _(t):
    df = _rounded(L.memory_utilization(A.reports(t)), "avg_memory_utilization", "max_memory_utilization")
    return _rounded(df, "avg_memory_used", "configured_memory", digits=4)


@query(
    "cold_starts",
    """SELECT min(duration) AS min_duration, round(avg(init_duration), 6) AS avg_init, max(init_duration) AS max_init,
              count(init_duration) AS num FROM reports WHERE type = 'REPORT'""",
)
def _(t):
    return _rounded(L.cold_starts(A.reports(t)), "avg_init")


@query(
    "cold_start_rate",
    """SELECT count(*) AS invocations, count(*) FILTER (init_duration > 0) AS cold_starts, round(avg(duration), 6) AS avg_duration,
              round(avg(init_duration), 6) AS avg_init_duration, max(init_duration) AS max_init_duration,
              round(count(*) FILTER (init_duration > 0) / count(*) * 100, 6) AS cold_start_rate,
              round(quantile_cont(duration, 0.95), 4) AS p95_duration
       FROM reports WHERE type = 'REPORT'""",
)
def _(t):
    df = _rounded(L.cold_start_rate(A.reports(t)), "avg_duration", "avg_init_duration", "cold_start_rate")
    return _rounded(df, "p95_duration", digits=4)


# --- free text ----------------------------------------------------------------------------------


@query(
    "cache_hit_rate",
    r"""SELECT tool, count(*) AS total_requests, count(*) FILTER (cs = 'hit') AS cache_hits, count(*) FILTER (cs = 'miss') AS cache_misses,
               round(avg(d), 6) AS avg_duration, max(d) AS max_duration, round(count(*) FILTER (cs = 'hit') / count(*) * 100, 6) AS hit_rate
        FROM (SELECT nullif(regexp_extract(message, '(?i)cache[:\s]+(hit|miss)', 1), '') AS cs,
                     TRY_CAST(regexp_extract(message, 'duration[:\s]+(\d+)', 1) AS BIGINT) AS d,
                     nullif(regexp_extract(message, 'tool[:\s]+([^\s,]+)', 1), '') AS tool
              FROM logs WHERE regexp_matches(message, '(?i)cache')) GROUP BY tool""",
)
def _(t):
    return _rounded(L.cache_hit_rate(A.logs(t)), "avg_duration", "hit_rate")


@query(
    "latency_by_tool",
    r"""SELECT tool, count(*) AS request_count, round(avg(duration), 4) AS avg_duration, max(duration) AS max_duration,
               round(avg(d), 6) AS avg_request_duration, max(d) AS max_request_duration,
               round(quantile_cont(duration, 0.95), 4) AS p95_duration, round(quantile_cont(duration, 0.99), 4) AS p99_duration
        FROM (SELECT nullif(regexp_extract(message, 'tool[:\s]+([^\s,]+)', 1), '') AS tool, duration,
                     TRY_CAST(regexp_extract(message, 'duration[:\s]+(\d+)', 1) AS BIGINT) AS d
              FROM logs WHERE regexp_matches(message, 'tool[:\s]+')) GROUP BY tool""",
)
def _(t):
    df = _rounded(L.latency_by_tool(A.logs(t)), "avg_duration", "p95_duration", "p99_duration", digits=4)
    return _rounded(df, "avg_request_duration")


@query(
    "latency_by_tool_approximate",
    r"""SELECT tool, count(*) AS request_count, true AS p95_within, true AS p99_within
        FROM (SELECT nullif(regexp_extract(message, 'tool[:\s]+([^\s,]+)', 1), '') AS tool
        FROM logs WHERE regexp_matches(message, 'tool[:\s]+')) GROUP BY tool""",
)
def _(t):
    """Sketched percentiles against the ranks that they stand for: the exact shares of smaller and of not larger values."""
    logs = A.logs(t)
    sketched = L.latency_by_tool(logs, approximate=True).select(F.col("tool").alias("of"), "request_count", "p95_duration", "p99_duration")
    durations = logs.where(F.col("message").rlike(r"tool[:\s]+")).select(parse_regex(F.col("message"), L.TOOL).alias("tool"), "duration")
    counts = durations.where("duration IS NOT NULL").groupBy("tool", "duration").agg(F.count(F.lit(1)).alias("n"))
    met = sketched.join(counts, F.col("of").eqNullSafe(F.col("tool")), "left")

    def within(name, share):
        value = F.col(name)
        below = F.sum(F.when(F.col("duration") < value, F.col("n")).otherwise(0))
        upto = F.sum(F.when(F.col("duration") <= value, F.col("n")).otherwise(0))
        # the sketch may be off by one row in ten thousand, and by the one that the rank falls into
        slack = F.sum("n") / 10_000 + 1
        return ((below <= share * F.sum("n") + slack) & (upto >= share * F.sum("n") - slack)) | F.sum("n").isNull()

    grouped = met.groupBy("of", "request_count").agg(within("p95_duration", 0.95).alias("p95_within"), within("p99_duration", 0.99).alias("p99_within"))
    return grouped.select(F.col("of").alias("tool"), "request_count", "p95_within", "p99_within")


@query(
    "errors_by_type",
    r"""SELECT coalesce(nullif(regexp_extract(message, '(TEMPLATE_NOT_FOUND|INVALID_INPUT|BUCKET_ACCESS_DENIED|GITHUB_RATE_LIMIT|S3_ERROR|DYNAMODB_ERROR)', 1), ''),
               nullif(regexp_extract(message, '(?i)error[:\s]+([^:]+):', 1), ''), 'Unknown') AS error_type, count(*) AS error_count
        FROM logs WHERE regexp_matches(message, '(?i)error|exception|failed') GROUP BY 1""",
)
def _(t):
    return L.errors_by_type(A.logs(t))


def _field(pattern: str) -> str:
    return f"nullif(regexp_extract(message, '{pattern}', 1), '')"


_BUCKET, _NAMESPACE, _ORG = (_field(p) for p in (L.BUCKET, L.NAMESPACE, L.ORG))


@query(
    "brown_outs",
    rf"""SELECT {_BUCKET} AS failed_bucket, {_ORG} AS failed_org, count(*) AS failure_count FROM logs
         WHERE regexp_matches(message, '(?i)brown-out|partial data|source failed|bucket.*skipped|user.*org.*failed') GROUP BY 1, 2""",
)
def _(t):
    return L.brown_outs(A.logs(t))


@query(
    "bucket_issues",
    rf"""SELECT {_BUCKET} AS bucket, {_field("(?i)(access denied|not found|missing tag|Allow=false|no IndexPriority)")} AS issue,
                count(*) AS issue_count FROM logs
         WHERE regexp_matches(message, '(?i)bucket') AND regexp_matches(message, '(?i)access denied|not found|missing tag|IndexPriority') GROUP BY 1, 2""",
)
def _(t):
    return L.bucket_issues(A.logs(t))


@query(
    "namespace_issues",
    rf"""SELECT {_BUCKET} AS bucket, {_NAMESPACE} AS namespace,
                {_field("(?i)(no IndexPriority|empty IndexPriority|namespace not found|invalid namespace)")} AS issue, count(*) AS issue_count
         FROM logs WHERE regexp_matches(message, '(?i)namespace') AND regexp_matches(message, '(?i)error|warning|IndexPriority') GROUP BY 1, 2, 3""",
)
def _(t):
    return L.namespace_issues(A.logs(t))


@query(
    "sidecar_issues",
    rf"""SELECT {_field("starter[:\\s]+([^\\s,]+)".replace(chr(92) * 2, chr(92)))} AS starter, {_BUCKET} AS bucket,
                {_field("(?i)(missing sidecar|invalid JSON|missing required field)")} AS issue, count(*) AS issue_count
         FROM logs WHERE regexp_matches(message, '(?i)sidecar') AND regexp_matches(message, '(?i)missing|invalid|error') GROUP BY 1, 2, 3""",
)
def _(t):
    return L.sidecar_issues(A.logs(t))


@query(
    "validation_errors",
    rf"""SELECT {_field(L.TOOL)} AS tool, {_field("parameter[:" + chr(92) + "s]+([^" + chr(92) + "s,]+)")} AS parameter,
                {_field("(?i)(missing required|invalid format|out of range|unknown parameter)")} AS validation_error, count(*) AS error_count
         FROM logs WHERE regexp_matches(message, '(?i)validation') AND regexp_matches(message, '(?i)error|invalid') GROUP BY 1, 2, 3""",
)
def _(t):
    return L.validation_errors(A.logs(t))


@query(
    "quota_floor",
    rf"""SELECT {_ORG} AS user_org, min(TRY_CAST(regexp_extract(message, 'X-RateLimit-Remaining[:\s]+(\d+)', 1) AS BIGINT)) AS min_remaining,
                max(TRY_CAST(regexp_extract(message, 'X-RateLimit-Limit[:\s]+(\d+)', 1) AS BIGINT)) AS rate_limit
         FROM logs WHERE regexp_matches(message, '(?i)github') AND regexp_matches(message, '(?i)rate limit|X-RateLimit') GROUP BY 1""",
)
def _(t):
    return L.quota_floor(A.logs(t))


@query(
    "discovery_performance",
    rf"""SELECT {_BUCKET} AS bucket, {_NAMESPACE} AS namespace, count(*) AS discovery_count, round(avg(duration), 4) AS avg_duration,
                CAST(sum(TRY_CAST(regexp_extract(message, 'templates found[:\s]+(\d+)', 1) AS BIGINT)) AS BIGINT) AS total_templates
         FROM logs WHERE regexp_matches(message, '(?i)list_templates|template discovery') GROUP BY 1, 2""",
)
def _(t):
    return _rounded(L.discovery_performance(A.logs(t)), "avg_duration", digits=4)


@query(
    "search_query_stats",
    r"""SELECT nullif(regexp_extract(message, 'query[:\s]+([^,]+)', 1), '') AS search_query, count(*) AS search_count,
               round(avg(TRY_CAST(regexp_extract(message, 'results[:\s]+(\d+)', 1) AS BIGINT)), 6) AS avg_results,
               round(avg(TRY_CAST(regexp_extract(message, 'duration[:\s]+(\d+)', 1) AS BIGINT)), 6) AS avg_duration,
               max(TRY_CAST(regexp_extract(message, 'duration[:\s]+(\d+)', 1) AS BIGINT)) AS max_duration
        FROM logs WHERE regexp_matches(message, '(?i)search_documentation') GROUP BY 1""",
)
def _(t):
    return _rounded(L.search_query_stats(A.logs(t)), "avg_results", "avg_duration")


@query(
    "access_by_tool_status",
    r"""SELECT nullif(regexp_extract(path, '/mcp/([^/?]+)', 1), '') AS tool, status, count(*) AS request_count,
               round(avg(response_length), 6) AS avg_response_size, count(*) FILTER (status >= 400) AS error_count,
               count(*) FILTER (status = 429) AS rate_limit_count FROM access_log GROUP BY 1, 2""",
)
def _(t):
    return _rounded(L.access_by_tool_status(A.access_log(t)), "avg_response_size")


# --- metrics ------------------------------------------------------------------------------------


def _series_sql(seconds: int) -> str:
    return f"""SELECT event_type AS metric, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds} AS period, count(*) AS samples,
         round(sum(value), 4) AS sum_value, round(avg(value), 4) AS avg_value, max(value) AS max_value, min(value) AS min_value,
         round(quantile_cont(value, 0.99), 4) AS p99_value
       FROM events GROUP BY 1, 2"""


def _series(t, seconds):
    df = L.metric_series(A.metrics(t), seconds).withColumn("period", F.unix_timestamp("period"))
    return _rounded(df, "sum_value", "avg_value", "p99_value", digits=4)


@query("metric_series_5_minutes", _series_sql(300))
def _(t):
    return _series(t, 300)


@query("metric_series_1_hour", _series_sql(3600))
def _(t):
    return _series(t, 3600)


@query(
    "alarm_error_sum",
    """SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 AS period, 'error' AS metric, round(sum(value), 4) AS statistic
       FROM events WHERE event_type = 'error' GROUP BY 1 HAVING sum(value) > 1""",
)
def _(t):
    df = L.alarms(A.metrics(t), "error", "sum", 1.0, 900)
    return _rounded(df.withColumn("period", F.unix_timestamp("period")), "statistic", digits=4)


@query(
    "alarm_duration_consecutive",
    """SELECT period, 'click' AS metric, round(statistic, 4) AS statistic FROM (
         SELECT *, lag(period) OVER (ORDER BY period) AS before FROM (
           SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS period, avg(value) AS statistic FROM events WHERE event_type = 'click' GROUP BY 1
           HAVING avg(value) > 5)) WHERE before = period - 300""",
)
def _(t):
    df = L.alarms(A.metrics(t), "click", "avg", 5.0, 300, consecutive=2)
    return _rounded(df.withColumn("period", F.unix_timestamp("period")), "statistic", digits=4)
