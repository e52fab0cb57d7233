"""Streams over several micro-batches give the batch answer."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorium.operators.windows import rolling_baseline
from sensorium.series import Series
from sensorium.streaming import streams


@pytest.fixture
def feed(spark, tmp_path):
    """Three files of one event each minute, in time order, and the readings they hold."""
    rng = np.random.default_rng(11)
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(minutes=7 * i), 1, "ab"[i % 2], float(round(rng.normal(60, 20), 2)), "{}") for i in range(240)]
    df = spark.createDataFrame(data, streams.EVENT_SCHEMA)
    for k in range(3):
        part = df.where(F.col("event_id").between(80 * k, 80 * k + 79)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    readings = df.select("ts", F.col("event_id").alias("row_index"), F.col("event_type").alias("tag"), "value")
    return str(tmp_path / "in"), readings, tmp_path


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(r[c], 8) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


def test_baseline_over_batches(spark, feed):
    folder, readings, tmp = feed
    stream = streams.event_stream(spark, folder, "*.parquet", files=1)
    streams.run_available(stream, str(tmp / "cp"), streams.baseline_writer(str(tmp / "out"), streams.KeptRows(str(tmp / "kept")), 10))
    got = spark.read.parquet(str(tmp / "out")).drop("batch")
    want = rolling_baseline(Series(readings), 10)
    assert spark.read.parquet(str(tmp / "out")).select("batch").distinct().count() == 3
    # The first rows of each later batch have their predecessors from the kept rows.
    assert rows(got.select("ts", "tag", "baseline_mean", "baseline_std")) == rows(want.select("ts", "tag", "baseline_mean", "baseline_std"))


def test_persistence_over_batches(spark, feed):
    folder, readings, tmp = feed
    stream = streams.event_stream(spark, folder, "*.parquet", files=1)
    streams.run_available(stream, str(tmp / "cp"), streams.persistence_writer(str(tmp / "out"), streams.KeptRows(str(tmp / "kept")), 75.0))
    got = spark.read.parquet(str(tmp / "out")).drop("batch")
    flagged = readings.withColumn("f", F.when(F.col("value") > 75, 1).otherwise(0))
    lane = Series(flagged).lane().rolling(2, 2, lambda w: {"support": F.sum("f").over(w.rowsBetween(-2, 2)), "_a": F.count("tag").over(w.rowsBetween(1, 2))})
    want = lane.done().where("_a = 2").select("ts", "tag", "support")
    assert rows(got.select("ts", "tag", "support")) == rows(want)


def test_finished_days_ignore_late_rows(spark, tmp_path):
    def event(i, day, value):
        return (i, dt.datetime(2024, 1, day, 12), 1, "t", value, "{}")

    for k, batch in enumerate([[event(0, 1, 1.0), event(1, 2, 2.0)], [event(2, 6, 3.0)], [event(3, 9, 4.0)], [event(4, 1, 100.0), event(5, 12, 5.0)]]):
        spark.createDataFrame(batch, streams.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.daily_buckets(streams.event_stream(spark, str(tmp_path / "in"), "*.parquet", files=1))
    streams.run_available(stream, str(tmp_path / "cp"), streams.parts_writer(str(tmp_path / "out")))
    got = {r["day"].day: (r["n"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == (1, 1.0) and got[2] == (1, 2.0)
