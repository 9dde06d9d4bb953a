"""A table that a stream writes one folder a batch, kept to few folders."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Batches whose folders are merged to one.
COMPACT_AFTER = 16


class BatchFolders:
    """``batch=N`` of single batches and ``upto=N`` of all batches up to one.

    A batch that is run again overwrites its own folder.  Every ``compact_after`` batches, those behind the last one are merged: the
    last one itself may still be run again.  What a merged folder replaces is deleted after it is complete; until then, and if that
    never happens, readers see the newest merged folder and the batches behind it only.
    """

    def __init__(self, root: str, merge: Callable[[DataFrame], DataFrame], compact_after: int | None = None):
        self.root = root
        self.merge = merge
        self.compact_after = compact_after or COMPACT_AFTER

    def _path(self, spark: SparkSession, *names: str):
        return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def folders(self, spark: SparkSession, before: int | None = None) -> list[str]:
        """Complete folders that count, of batches before ``before`` if given."""
        path = self._path(spark)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        done = [(m[1], int(m[2])) for n in names if (m := re.fullmatch(r"(upto|batch)=(\d+)", n)) and system.exists(self._path(spark, n, "_SUCCESS"))]
        done = [(kind, n) for kind, n in done if before is None or n < before]
        last = max((n for kind, n in done if kind == "upto"), default=-1)
        return [f"upto={last}"] * (last >= 0) + [f"batch={n}" for kind, n in sorted(done) if kind == "batch" and n > last]

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        names = self.folders(spark, before)
        return spark.read.parquet(*[f"{self.root}/{n}" for n in names]) if names else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        if batch_id % self.compact_after == self.compact_after - 1:
            self._compact(rows.sparkSession, batch_id - 1)

    def _compact(self, spark: SparkSession, upto: int) -> None:
        names = self.folders(spark, upto + 1)
        if not names or f"upto={upto}" in names:
            return
        self.merge(self.read(spark, upto + 1)).write.mode("overwrite").parquet(f"{self.root}/upto={upto}")
        self.drop(spark, names)

    def drop(self, spark: SparkSession, names: list[str]) -> None:
        for name in names:
            path = self._path(spark, name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
