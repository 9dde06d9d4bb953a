"""Session settings every job relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; all of them can be changed on a live session.
RUNTIME_SETTINGS = {
    # Epoch arithmetic and window boundaries are defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A rebuild of one version replaces only that version's partition.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole documents; batches of ten thousand of them fill a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings, send the package to the executors and return the same session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started: once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shelfmark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(archive)  # Spark serves it to executors from the driver
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows only when the scan gives fewer tasks than there are cores.

    For inputs of few large files whose rows are expensive to process; a scan that already has a task
    for every core is left as it is, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back: nothing is computed twice or lost with an executor."""
    path = work_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Whether Spark removes the shuffle files of a query when it ends; else they stay until the driver's garbage is collected.
_REMOVED_AT_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, as nothing reads them again; the caller's queries keep theirs."""
    before = spark.conf.get(_REMOVED_AT_END, None)
    spark.conf.set(_REMOVED_AT_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVED_AT_END)
        else:
            spark.conf.set(_REMOVED_AT_END, before)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    It lies below ``spark.checkpoint.dir``, which every executor can reach.  Only where a session on one machine has
    none, as in tests, is a temporary folder set as that directory, and removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
