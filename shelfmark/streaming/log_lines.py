"""Parsing of log lines as they arrive: stateless, so any batch report works on the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.logs import CACHE_FIELDS, RESPONSE_FIELDS, parse_glob


def parsed_lines(logs: DataFrame) -> DataFrame:
    """Tag and the fields of both bracketed formats beside the line; fields that do not apply are null."""
    df = logs
    for name, tag, fields in (("response", "RESPONSE", RESPONSE_FIELDS), ("cache", "CACHE", CACHE_FIELDS)):
        parsed = parse_glob(df, fields, df.columns)
        own = F.struct("logging_type", *fields)
        df = parsed.withColumn(name, F.when(F.col("logging_type") == tag, own)).drop("logging_type", *fields)
    return df


def start_parsing(logs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append parsed lines to parquet; the file sink's log makes a repeated batch harmless."""
    return (
        parsed_lines(logs)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
