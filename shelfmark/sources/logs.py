"""Log groups as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """Lines of all groups with their group in ``log_group``; missing fields are null."""
    tagged = [df.withColumn("log_group", F.lit(name)) for name, df in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_log_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text lines as ``message`` with the file they came from in ``log_stream``."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("log_stream"))


def read_json_logs(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """JSON log records of a known schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)
