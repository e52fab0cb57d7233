"""Streams over the event table, read back as tables."""

from pyspark.sql import functions as F

from catalog.base import SENSOR, center_scale, query, r, rs, scratch_folder
from catalog.windows import _BASE30, _baseline
from sensorium.operators import stats
from sensorium.sources import shapes
from sensorium.streaming import streams


def _run(spark, stream, write, mode="append"):
    base = scratch_folder(spark)
    streams.run_available(stream, f"{base}/checkpoint", write(base), mode)
    return spark.read.parquet(f"{base}/out").drop("batch")


def _plain(base):
    return streams.parts_writer(f"{base}/out")


_DONE = "(SELECT max(ts) FROM sensor) - INTERVAL 1 DAY"


@query(
    "l1_stream_daily_buckets",
    f"WITH {SENSOR}, d AS (SELECT CAST(ts AS DATE) AS day, tag, count(value) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high FROM sensor GROUP BY 1, 2) "
    f"SELECT day, tag, n, {rs('mean', 'low', 'high')} FROM d WHERE day + INTERVAL 1 DAY <= {_DONE}",
)
def _(spark, folder):
    """L1 and L7: finished days only."""
    return _run(spark, streams.daily_buckets(streams.event_stream(spark, folder)), _plain)


@query(
    "l2_stream_score_frozen_limits",
    f"WITH {SENSOR}, {center_scale('sensor', 'value', 'c')}, z AS (SELECT ts, s.tag, value, (value - center) / scale AS z FROM sensor s JOIN c USING (tag)) "
    f"SELECT ts, tag, {rs('value', 'z')}, CASE WHEN abs(z) >= 5 THEN 'Strong Anomaly' WHEN abs(z) >= 3.5 THEN 'Drift + Anomaly' WHEN abs(z) >= 3 THEN 'Drift' ELSE 'Normal' END AS final_class FROM z",
)
def _(spark, folder):
    s = shapes.sensor_long(spark, folder)
    limits = stats.robust_scale(s)
    scored = streams.score_frozen(streams.event_stream(spark, folder), limits, s.tags)
    return _run(spark, scored, _plain).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "tag", "value", "z", "final_class")


@query("l3_stream_rolling_baseline", _baseline(_BASE30), digits=7)
def _(spark, folder):
    df = _run(spark, streams.event_stream(spark, folder), lambda b: streams.baseline_writer(f"{b}/out", streams.KeptRows(f"{b}/kept")))
    return df.select("ts", "tag", "value", "baseline_mean", "baseline_std", "z_score", "lower_limit", "upper_limit")


@query(
    "l4_stream_persistence",
    f"WITH {SENSOR}, w AS (SELECT ts, tag, value, value > 75 AS flag, CAST(sum(CASE WHEN value > 75 THEN 1 ELSE 0 END) OVER c AS BIGINT) AS support, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, row_index DESC) AS back "
    "FROM sensor WINDOW c AS (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) "
    f"SELECT ts, tag, {rs('value')}, flag, support FROM w WHERE back > 2",
)
def _(spark, folder):
    return _run(spark, streams.event_stream(spark, folder), lambda b: streams.persistence_writer(f"{b}/out", streams.KeptRows(f"{b}/kept"), 75.0))


@query(
    "l5_stream_periods",
    f"WITH {SENSOR}, g AS (SELECT *, lag(ts) OVER (PARTITION BY tag ORDER BY ts) AS prev FROM sensor WHERE value > 180), "
    "p AS (SELECT *, sum(CASE WHEN ts - prev <= INTERVAL 48 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY tag ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pid FROM g), "
    f"s AS (SELECT tag, min(ts) AS start_ts, max(ts) AS end_ts, count(value) AS points, max(value) AS peak FROM p GROUP BY tag, pid) SELECT tag, start_ts, end_ts, points, {rs('peak')} FROM s WHERE end_ts + INTERVAL 48 HOURS <= (SELECT max(ts) FROM sensor WHERE value > 180) - INTERVAL 1 DAY",
)
def _(spark, folder):
    return _run(spark, streams.flagged_periods(streams.event_stream(spark, folder).where("value > 180")), _plain)


@query(
    "l6_stream_sliding_mean",
    f"WITH {SENSOR}, e AS (SELECT CAST(CAST(ts AS DATE) + INTERVAL 1 DAY + k * INTERVAL 1 DAY AS TIMESTAMP) AS span_end, tag, value FROM sensor, range(0, 5) r(k)) "
    f"SELECT span_end, tag, {r('avg(value)', 'mean')}, count(value) AS n FROM e WHERE span_end <= {_DONE} GROUP BY 1, 2",
    digits=8,
)
def _(spark, folder):
    return _run(spark, streams.sliding_mean(streams.event_stream(spark, folder)), _plain)


@query("l8_dedupe_stream", f"WITH {SENSOR} SELECT ts, row_index, tag, {rs('value')} FROM sensor")
def _(spark, folder):
    """Every reading offered twice arrives once."""
    s = streams.event_stream(spark, folder)
    df = _run(spark, streams.deduped(s.union(s), ["row_index", "tag"]), _plain)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
