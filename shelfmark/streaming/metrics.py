"""Tumbling metric aggregates and alarms over a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.operators.logs import metric_aggregates, period_start
from shelfmark.streaming.folders import BatchFolders

#: Size of a quantile sketch: its ranks are off by about 1.65 % at most, whatever the order of arrival.
SKETCH_K = 200


def _partial(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("metric", "period").agg(
        *metric_aggregates(), F.count("value").alias("values"), F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch")
    )


def _merged(written: DataFrame) -> DataFrame:
    """Partial aggregates of one metric and period as one."""
    total = F.sum("sum_value")
    return written.groupBy("metric", "period").agg(
        F.sum("samples").alias("samples"), total.alias("sum_value"), F.try_divide(total, F.sum("values")).alias("avg_value"),
        F.max("max_value").alias("max_value"), F.min("min_value").alias("min_value"), F.sum("values").alias("values"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


class MetricStream:
    """Writes the partial aggregates of each micro-batch, which are merged when read: a sample counts however late it is.

    A batch that is run again overwrites its own partial aggregates; those of old batches are merged, so folders stay few.
    """

    def __init__(self, root: str, seconds: int = 300, compact_after: int | None = None):
        self.seconds = seconds
        self.periods = BatchFolders(f"{root}/periods", _merged, compact_after)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.periods.write(_partial(batch.withColumn("period", period_start(F.col("ts"), self.seconds))), batch_id)

    def start(self, metrics: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            metrics.writeStream.foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def series(self, spark: SparkSession) -> DataFrame:
        """metric, period, samples, sum_value, avg_value, max_value, min_value and the sketched p99_value of every period."""
        merged = _merged(self.periods.read(spark))
        p99 = F.when(F.col("values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.99)))
        return merged.withColumn("p99_value", p99).drop("values", "sketch")


# --- alarms ---------------------------------------------------------------------------------------

ALARM_SCHEMA = "metric string, period timestamp, state string, statistic double"


class _Alarms(StatefulProcessor):
    """Sums and counts of the periods of one metric, and which periods are in alarm.

    A period is judged whenever a sample comes for it or for one of the ``consecutive`` - 1 periods before; a change of
    its state is a row, so a late sample may fire or clear.  State of a period ends a retention time after its last sample.
    """

    def __init__(self, statistic: str, threshold: float, seconds: int, consecutive: int, retention_ms: int | None):
        self.statistic, self.threshold, self.seconds, self.consecutive = statistic, threshold, seconds, consecutive
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.periods = handle.getMapState(
            "periods", "start long", "total double, samples long, low double, high double, alarm boolean", self.retention_ms
        )

    def _value(self, row: tuple | None) -> float | None:
        if row is None or not row[1]:
            return None
        total, samples, low, high, _ = row
        return {"sum": total, "avg": total / samples, "min": low, "max": high}[self.statistic]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[int, list] = {}
        for batch in rows:
            own = batch.assign(start=batch["second"] // self.seconds * self.seconds).dropna(subset=["value"])
            for start, values in own.groupby("start")["value"]:
                part = [float(values.sum()), int(values.count()), float(values.min()), float(values.max())]
                if (old := touched.get(int(start))) is not None:
                    part = [old[0] + part[0], old[1] + part[1], min(old[2], part[2]), max(old[3], part[3])]
                touched[int(start)] = part
        for start, (total, samples, low, high) in touched.items():
            alarm = False
            if self.periods.containsKey((start,)):
                old = tuple(self.periods.getValue((start,)))
                total, samples, alarm = old[0] + total, old[1] + samples, old[4]
                low, high = (min(old[2], low), max(old[3], high)) if old[1] else (low, high)
            self.periods.updateValue((start,), (total, samples, low, high, alarm))
        changes = []
        for start in sorted({s + k * self.seconds for s in touched for k in range(self.consecutive)}):
            if not self.periods.containsKey((start,)):
                continue
            run = [start - k * self.seconds for k in range(self.consecutive)]
            values = [self._value(tuple(self.periods.getValue((s,))) if self.periods.containsKey((s,)) else None) for s in run]
            alarm = all(v is not None and v > self.threshold for v in values)
            now = tuple(self.periods.getValue((start,)))
            if alarm or alarm != now[4]:
                changes.append((key[0], datetime.fromtimestamp(start, timezone.utc), "ALARM" if alarm else "OK", values[0]))
            if alarm != now[4]:
                self.periods.updateValue((start,), (*now[:4], alarm))
        yield pd.DataFrame(changes, columns=["metric", "period", "state", "statistic"])

    def close(self) -> None:
        pass


def alarm_changes(
    metrics: DataFrame, statistic: str, threshold: float, seconds: int, consecutive: int = 1, retention_ms: int | None = None
) -> DataFrame:
    """metric, period, state (``ALARM`` or ``OK``), statistic: a row for every judgement that differs from the one before.

    ``metrics`` is a stream of metric, ts, value.  A period is in alarm while its statistic and those of the ``consecutive`` - 1 periods
    before it exceed the threshold, as in the batch operator; null values do not count.
    """
    rows = metrics.select("metric", F.unix_timestamp("ts").alias("second"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("metric").transformWithStateInPandas(
        _Alarms(statistic, threshold, seconds, consecutive, retention_ms), ALARM_SCHEMA, "Update", "ProcessingTime" if retention_ms else "None"
    )


class AlarmStream:
    """Keeps what :func:`alarm_changes` says, batch by batch; the newest judgement of a period holds."""

    def __init__(self, root: str, statistic: str, threshold: float, seconds: int, consecutive: int = 1, retention_ms: int | None = None):
        self.root = root
        self.rule = (statistic, threshold, seconds, consecutive, retention_ms)

    def start(self, metrics: DataFrame, checkpoint: str) -> StreamingQuery:
        spark = metrics.sparkSession
        # several state variables of a key need this store
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/changes/batch_id={batch_id}")

        changes = alarm_changes(metrics, *self.rule).writeStream.outputMode("update")
        return changes.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def alarms(self, spark: SparkSession) -> DataFrame:
        """period, metric, statistic of every period that is in alarm."""
        schema = f"{ALARM_SCHEMA}, batch_id bigint"
        changes = spark.read.schema(schema).parquet(f"{self.root}/changes")
        newest = changes.groupBy("metric", "period").agg(F.max_by(F.struct("state", "statistic"), "batch_id").alias("now"))
        return newest.where("now.state = 'ALARM'").select("period", "metric", "now.statistic")
