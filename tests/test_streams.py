"""Streams over several micro-batches, with samples that come late."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.logs import alarms, metric_series
from shelfmark.streaming.metrics import AlarmStream, MetricStream

SCHEMA = "metric string, ts timestamp, value double"


def _samples(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("m"), F.col("id") % 2).alias("metric"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"),
        F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("value"),
        (F.col("id") * 7 % 5).alias("part"),
    )


def _run(spark, stream, samples, parts, tmp_path):
    source = str(tmp_path / "in")
    for part in parts:
        samples.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        arriving = spark.readStream.schema(SCHEMA).parquet(source)
        stream.start(arriving, str(tmp_path / "checkpoint")).awaitTermination()


@pytest.mark.parametrize("parts", [(0, 1, 2, 3, 4), (4, 1, 0, 3, 2)])
def test_sketched_p99_in_any_order_of_arrival(spark, tmp_path, parts):
    samples = _samples(spark, 3000).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.unix_timestamp("ts") % 7200))
    stream = MetricStream(str(tmp_path / "out"), 3600, compact_after=2)
    _run(spark, stream, samples, parts, tmp_path)
    assert len(stream.periods.folders(spark)) <= 3
    plain = ["metric", "period", "samples", "sum_value", "avg_value", "max_value", "min_value"]
    streamed = stream.series(spark)
    batch = metric_series(samples, 3600, p99=False).select(*plain)
    assert streamed.select(*plain).exceptAll(batch).count() == 0 and streamed.count() == batch.count()
    values = {}
    for r in samples.where("value IS NOT NULL").selectExpr("metric", "window(ts, '3600 seconds').start AS period", "value").collect():
        values.setdefault((r["metric"], r["period"]), []).append(r["value"])
    for r in streamed.collect():
        own = values[(r["metric"], r["period"])]
        below, upto = (sum(f(v) for v in own) / len(own) for f in (lambda v: v < r["p99_value"], lambda v: v <= r["p99_value"]))
        assert below <= 0.99 + 0.0165 and upto >= 0.99 - 0.0165


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    stream, samples = MetricStream(str(tmp_path / "out"), 3600, compact_after=2), _samples(spark)
    for batch_id in (0, 1, 1, 2, 3, 3):
        stream.write(samples.where(F.col("part") == batch_id).drop("part"), batch_id)
    want = metric_series(samples.where("part < 4"), 3600, p99=False).select("metric", "period", "samples", "sum_value")
    assert stream.series(spark).select(*want.columns).exceptAll(want).count() == 0
    empty = MetricStream(str(tmp_path / "empty"), 3600)
    empty.write(samples.where("false").drop("part"), 0)
    assert empty.series(spark).collect() == []


def test_late_samples_fire_and_clear_alarms(spark, tmp_path):
    second = lambda k: 1_700_000_100 + 300 * k
    parts = [
        [("m", 0, 9.0), ("m", 1, 9.0), ("m", 3, 9.0), ("x", 0, 1.0)],  # 1 in alarm
        [("m", 2, 9.0), ("m", 4, 1.0), ("m", 9, None)],  # a late one: 2 and 3 as well
        [("m", 1, -20.0)],  # 1 is no breach any more: 1 and 2 clear
        [("m", 4, 30.0), ("x", 1, 50.0)],  # 4 fires
    ]
    rows = [(m, second(k), v, part) for part, some in enumerate(parts) for m, k, v in some]
    samples = spark.createDataFrame(rows, "metric string, second bigint, value double, part int")
    samples = samples.select("metric", F.timestamp_seconds("second").alias("ts"), "value", "part")
    stream = AlarmStream(str(tmp_path / "out"), "avg", 5.0, 300, 2)
    starts = []
    source = str(tmp_path / "in")
    for part in range(4):
        samples.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        stream.start(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
        found = stream.alarms(spark)
        some = samples.where(F.col("part") <= part)
        want = alarms(some, "m", "avg", 5.0, 300, 2).unionByName(alarms(some, "x", "avg", 5.0, 300, 2))
        assert sorted(map(tuple, found.select("period", "metric", "statistic").collect())) == sorted(map(tuple, want.collect()))
        starts.append(found.count())
    assert starts == [1, 3, 1, 2]


def test_late_requests_after_many_batches(spark, tmp_path):
    """Counts of closed windows stay in few folders, and judge requests that come many batches later."""
    from shelfmark.operators.rate_limit import rate_limited
    from shelfmark.streaming.rate_limit import RateLimitStream

    stream = RateLimitStream(str(tmp_path / "out"), 2, 60, compact_after=3)
    rows = [(f"c{k % 3}", 3600 * (k // 2) + k, k, k // 2) for k in range(14)] + [("c0", 7, 90, 7), ("c1", 3605, 91, 7)]
    schema = "client string, second bigint, request_id bigint, part bigint"
    requests = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("second") + 1_699_999_200)).drop("second")
    for part in [0, 1, 2, 2, 3, 4, 5, 5, 6, 7]:
        stream.process(requests.where(F.col("part") == part).drop("part"), part)
    columns = ["request_id", "nth", "allowed", "remaining", "retry_after"]
    want = rate_limited(requests.drop("part"), 2, 60).select(*columns)
    assert stream.verdicts(spark).select(*columns).exceptAll(want).count() == 0
    assert len(stream.closed.folders(spark)) <= 4 and len(list((tmp_path / "out" / "counts").iterdir())) <= 3
