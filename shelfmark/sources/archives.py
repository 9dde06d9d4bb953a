"""Repository archives and file trees as ``path, content`` tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text from which on a task hands out the rows it has read.
FRAME_CHARACTERS = 1 << 22


def _members(data: bytes) -> Iterator[tuple[int, str, str]]:
    """Position, path below the root folder, and text of every readable file of an archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for position, info in enumerate(archive.infolist()):
            path = info.filename.partition("/")[2] if "/" in info.filename else info.filename
            if info.is_dir() or not path:
                continue
            try:
                yield position, path, archive.read(info).decode("utf-8", errors="replace")
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                continue  # a damaged member leaves the others readable


_COLUMNS = ["archive", "file_ord", "path", "content", "error"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"file_ord": "Int64"})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A frame costs more than a small archive, so archives share one until it holds ``FRAME_CHARACTERS``."""
    for batch in batches:
        rows, size = [], 0
        for name, data in zip(batch["archive"], batch["data"]):
            try:
                found = [(name, *member, None) for member in _members(bytes(data))]
            except zipfile.BadZipFile as error:
                found = [(name, None, None, None, str(error))]
            rows += found
            size += sum(len(row[3] or "") for row in found)
            if size >= FRAME_CHARACTERS:
                yield _frame(rows)
                rows, size = [], 0
        if rows:
            yield _frame(rows)


def unzip(archives: DataFrame) -> DataFrame:
    """``archive, data`` (binary) to ``archive, file_ord, path, content, error``.

    An unreadable archive gives one row with ``error``.
    """
    schema = "archive string, file_ord bigint, path string, content string, error string"
    return archives.select("archive", "data").mapInPandas(_read, schema)


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """All zip files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return unzip(files.select(F.col("path").alias("archive"), F.col("content").alias("data")))


def read_tree(spark: SparkSession, path: str, extensions: Sequence[str] = ("html", "json")) -> DataFrame:
    """Files below a folder with one of the extensions: ``path`` (relative) and ``html`` (whole text)."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    qualified = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .text(path, wholetext=True)
    )
    full = F.regexp_replace(F.col("_metadata.file_path"), r"\A[a-z0-9]+:(//[^/]*)?(?=/)", "")
    relative = F.substring(full, len(qualified.rstrip("/")) + 2, 1 << 20)
    return files.select(relative.alias("path"), F.col("value").alias("html"))
