"""Rate limiting of a request stream.

Every micro-batch is numbered with the same native, skew-safe operator as a batch table; the only
state is how many requests each (client, window) has had.  Counts of open windows are carried from batch
to batch; those of a window that closes are set aside once, and a late request is judged by them: it comes
after all requests of its window that arrived before.  Counts and verdicts of a batch go to folders named
after the batch, and a batch reads only what earlier ones wrote, so a batch that is run again after a failure
overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.rate_limit import STATE_GRACE_MS, WINDOW_KEYS, numbered_in_window, verdicts, with_windows
from shelfmark.streaming.folders import BatchFolders

COUNTS_SCHEMA = "client string, reset_ms bigint, window_minutes int, seen bigint"


def _summed(counts: DataFrame) -> DataFrame:
    """Counts of a window as one, by the windows' ends, so that a reader of late requests skips most of them."""
    return counts.groupBy(*WINDOW_KEYS).agg(F.sum("seen").alias("seen")).repartitionByRange("reset_ms").sortWithinPartitions("reset_ms")


class RateLimitStream:
    """Writes verdicts below ``{root}/verdicts`` and counts below ``{root}/counts`` (open windows) and ``{root}/closed``.

    A count is in one of the two.  Closed counts are kept, in few folders; a batch reads those of the windows from its oldest request
    on.  Of the open counts the last three batches' are there, and those before them below ``{root}/before``: a batch needs those before
    it, and each of the three may be run again.
    """

    def __init__(self, root: str, limit: int | None = None, window_minutes: int | None = None, compact_after: int | None = None):
        self.root = root
        self.limit = limit
        self.window_minutes = window_minutes
        self.counts = BatchFolders(f"{root}/counts", _summed)
        self.before = BatchFolders(f"{root}/before", _summed)
        self.closed = BatchFolders(f"{root}/closed", _summed, compact_after)

    def _previous_counts(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id > 0:
            name = f"batch={batch_id - 1}"
            held = next((f for f in (self.counts, self.before) if name in f.folders(spark)), None)
            if held is None:
                raise RuntimeError(f"counts of batch {batch_id - 1} are missing")
            return spark.read.schema(COUNTS_SCHEMA).parquet(f"{held.root}/{name}")
        return spark.createDataFrame([], COUNTS_SCHEMA)

    def _closed_counts(self, spark: SparkSession, batch_id: int, oldest: int | None) -> DataFrame:
        """What earlier batches set aside of the windows that end at ``oldest`` or later."""
        if batch_id == 0 or oldest is None:
            return spark.createDataFrame([], COUNTS_SCHEMA)
        closed = self.closed.read(spark, batch_id)
        if closed is None:
            raise RuntimeError(f"closed counts before batch {batch_id} are missing")
        return closed.where(F.col("reset_ms") >= oldest)

    def _set_aside(self, spark: SparkSession, batch_id: int) -> None:
        """Leave the counts of a batch to the one after it only; complete there before they are dropped here."""
        name = f"batch={batch_id}"
        if batch_id >= 0 and name in self.counts.folders(spark):
            spark.read.schema(COUNTS_SCHEMA).parquet(f"{self.counts.root}/{name}").write.mode("overwrite").parquet(f"{self.before.root}/{name}")
            self.counts.drop(spark, [name])
            self.before.drop(spark, [f"batch={batch_id - 1}"] if batch_id else [])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        still_open = self._previous_counts(spark, batch_id)
        windowed = with_windows(batch, self.limit, self.window_minutes)
        bounds = windowed.agg(F.min("reset_ms").alias("oldest"), F.max(F.unix_millis("ts")).alias("newest")).first()
        closed = self._closed_counts(spark, batch_id, bounds["oldest"])
        arrived = windowed.groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("seen"))
        seen = still_open.unionByName(closed).join(arrived.select(*WINDOW_KEYS), WINDOW_KEYS, "left_semi")
        seen = seen.groupBy(*WINDOW_KEYS).agg(F.sum("seen").alias("seen"))
        numbered = numbered_in_window(windowed).join(seen, WINDOW_KEYS, "left")
        carried = numbered.withColumn("nth", F.col("nth") + F.coalesce("seen", F.lit(0))).drop("seen")
        path = f"{self.root}/verdicts/batch_id={batch_id}"
        verdicts(carried).write.mode("overwrite").parquet(path)

        counts = still_open.unionByName(arrived).groupBy(*WINDOW_KEYS).agg(F.sum("seen").alias("seen"))
        # The newest event time of the batch closes old windows.
        newest = F.lit(bounds["newest"]).cast("bigint")
        is_open = newest.isNull() | F.coalesce(F.col("reset_ms") + STATE_GRACE_MS > newest, F.lit(False))
        self.closed.write(counts.where(~is_open), batch_id)
        counts.where(is_open).write.mode("overwrite").parquet(f"{self.counts.root}/batch={batch_id}")
        self._set_aside(spark, batch_id - 3)

    def start(self, requests: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
        return writer.start()

    def verdicts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/verdicts")
