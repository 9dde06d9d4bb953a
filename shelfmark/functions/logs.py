"""Fields out of log messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed field orders of the two bracketed line formats, after the tag.
RESPONSE_FIELDS = [
    "status_code", "bytes", "content_type", "exec_time", "client_ip", "user_agent", "origin", "referrer", "resource",
    "query_keys", "path_log", "query_log", "key",
]
CACHE_FIELDS = ["id", "endpoint", "result", "exec_time"]

_TAGGED = r"(?s)\A[^\[]*\[(.*?)\] (.*)\z"


def parse_glob(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``logging_type`` and the fields of ``[*] * | * ...`` in ``message``.

    All are null when the shape does not fit.  Tag and rest are taken out once, in a step of their own.
    """
    m = F.col("message")
    tagged = df.withColumns({"_tag": F.regexp_extract(m, _TAGGED, 1), "_rest": F.regexp_extract(m, _TAGGED, 2), "_fits": m.rlike(_TAGGED)})
    split = tagged.withColumn("_parts", F.when(F.col("_fits"), F.split("_rest", r" \| ", len(fields))))
    fits = F.size("_parts") == len(fields)
    return split.select(
        *keep,
        F.when(fits, F.col("_tag")).alias("logging_type"),
        *[F.when(fits, F.get("_parts", F.lit(i))).alias(name) for i, name in enumerate(fields)],
    )


def parse_regex(message: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, or null when the pattern does not match."""
    return F.nullif(F.regexp_extract(message, pattern, group), F.lit(""))


def like(message: Column, *patterns: str) -> Column:
    """Whether any of the patterns occurs, ignoring case."""
    result = F.lit(False)
    for pattern in patterns:
        result = result | message.rlike(f"(?i){pattern}")
    return result


def number(message: Column, pattern: str) -> Column:
    return parse_regex(message, pattern).try_cast("bigint")
