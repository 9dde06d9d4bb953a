"""What several operators share: folds, bounded label samples, stored tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import work_dir

__all__ = ["fold", "labelled_sample", "release_memory", "sized_slices", "slices", "stored", "text_bytes"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back: computed once, and lost with no executor."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a document's id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, learnable: Column
) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """At most ``per_class`` labelled whole texts of either class of ``label``, and how many label rows each class has.

    The texts come as (doc_id, class, text).

    Rows count as learnable where ``learnable`` (over ``doc_id``) holds, the label is 0 or 1 and the text has 1 to
    ``max_bytes`` bytes.  Which rows are taken depends on a hash of their id alone: rows below a hash bound that
    lets through about twice the wanted number, and of those the smallest hashes.  A document with both labels counts
    in both classes; repeated label rows count once.  The sample is bounded by ``2 * per_class * max_bytes``.
    """
    spark = docs.sparkSession
    marks = (
        labels.select("doc_id", F.col(label).cast("int").alias("class"))
        .where(F.col("doc_id").isNotNull() & F.col("class").isin(0, 1))
        .where(learnable)
        .withColumn("mark", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    )
    sizes = {r["class"]: r["n"] for r in marks.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], {}
    below = F.lit(False)
    for value, n in sizes.items():
        below = below | ((F.col("class") == value) & (F.col("mark") < int((1 << 30) * min(1.0, 2.0 * per_class / n))))
    # about four times per_class rows of three numbers at most, so the broadcast below is bounded
    wanted = [tuple(r) for r in marks.where(below).select("doc_id", "class", "mark").distinct().collect()]
    if not wanted:
        return [], sizes
    wanted = spark.createDataFrame(wanted, "doc_id long, class int, mark long")
    eligible = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.octet_length("text").between(1, max_bytes)
    )
    found = eligible.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id", "class"])
    rows = []
    for value in (0, 1):
        top = found.where(F.col("class") == value).orderBy("mark", "doc_id").limit(per_class)
        rows += [(r["doc_id"], value, r["text"]) for r in top.select("doc_id", "text").collect()]
    return rows, sizes


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the start of each row (and the end of the last); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    # bytes below null rows are none, as Arrow's writers leave them out
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows each, so that what is made per batch stays bounded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where a column of texts reaches about ``size`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        starts = text_bytes(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def release_memory() -> None:
    """Give back to the system what earlier stages have left in this worker: Arrow's pool, and the free pages that glibc keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)
