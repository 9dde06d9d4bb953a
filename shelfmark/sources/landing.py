"""Sources landed one by one, so that a damaged file of one of them becomes an error row and not a failed job."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import stored

ERRORS_SCHEMA = "source string, source_type string, path string, error string"


def _listing(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Paths of a folder's Parquet files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.lit(name).alias("source"), F.col("path"))


def _rows(spark: SparkSession, name: str, folder: str, schema: str) -> DataFrame:
    """What can be read of a folder: a file that cannot be opened gives no row, one damaged further on those before the damage."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    rows = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(folder)
    return rows.withColumns({"source": F.lit(name), "_path": F.col("_metadata.file_path")})


def _why(spark: SparkSession, path: str) -> str | None:
    """What a strict reader says of a file, None if it is sound."""
    try:
        spark.read.parquet(path).write.format("noop").mode("overwrite").save()
    except PySparkException as error:
        return str(error).split("\n")[0]
    except Exception as error:  # noqa: BLE001  a damaged footer fails in the driver with whatever the format's reader throws
        return f"{type(error).__name__}: {str(error).splitlines()[0]}"
    return None


def land_sources(
    spark: SparkSession, folders: dict[str, str], schema: str, source_type: str = "s3"
) -> tuple[DataFrame, DataFrame, bool]:
    """``(rows, errors, partial)``: all readable rows of every source's Parquet files with ``source``, stored, and what failed.

    The listing of every source is held against the rows that were read, file by file: a file without rows is read again strictly, and one
    with fewer rows than its footer counts is reported as well.  A folder that is not there is one error row without a path.
    Errors name files; rows of other files and other sources stay.
    """
    failures, present = [], []
    for name, folder in folders.items():
        try:
            _listing(spark, name, folder)
            present.append((name, folder))
        except (AnalysisException, OSError, ValueError) as error:
            failures.append((name, source_type, None, str(error).split("\n")[0]))
    empty = spark.createDataFrame([], f"{schema}, source string")
    if present:
        landed = stored(reduce(DataFrame.unionByName, [_rows(spark, *p, schema) for p in present]), "landed")
        listed = reduce(DataFrame.unionByName, [_listing(spark, *p) for p in present])
        # footers alone tell how many rows a file should have
        counted = reduce(DataFrame.unionByName, [_rows(spark, *p, schema).select("source", "_path") for p in present])
        expected = counted.groupBy("source", "_path").agg(F.count(F.lit(1)).alias("expected"))
        read = landed.groupBy("source", "_path").agg(F.count(F.lit(1)).alias("found"))
        plain = lambda path: F.regexp_replace(F.url_decode(path), "^file:/+", "/")
        files = listed.withColumn("_key", plain(F.col("path")))
        known = expected.join(read, ["source", "_path"], "left").withColumn("_key", plain(F.col("_path"))).drop("_path")
        doubtful = files.join(known, ["source", "_key"], "left").where(F.coalesce("found", F.lit(0)) < F.coalesce("expected", F.lit(1)))
        for row in doubtful.select("source", "path", "expected", "found").toLocalIterator():  # files without rows, or with too few
            why = f"{row['found'] or 0} of {row['expected']} rows could be read" if row["expected"] else _why(spark, row["path"])
            if why is not None:
                failures.append((row["source"], source_type, row["path"], why))
        empty = landed.drop("_path")
    errors = spark.createDataFrame(failures, ERRORS_SCHEMA).withColumn("timestamp", F.current_timestamp())
    return empty, errors, bool(failures)
