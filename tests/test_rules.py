"""Rules that the shapes of the test tables do not show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorium.operators import clusters, pairs, report
from sensorium.series import Series
from sensorium.sources import ingest

START = dt.datetime(2024, 1, 1)


def test_readings_of_one_time_are_averaged(spark):
    rows = []
    for k in range(40):
        x = float((k * 7) % 11)
        rows += [(START + dt.timedelta(hours=k), "a", x + d) for d in (-3.0, 3.0)] + [(START + dt.timedelta(hours=k), "b", x)]
    got = pairs.pearson(Series(spark.createDataFrame(rows, "ts timestamp_ntz, tag string, value double"))).first()
    assert got["r"] == pytest.approx(1.0)


def test_result_columns_are_no_tags(spark):
    names = ["predicted", "upper_limit", "z_score", "drift_score", "serial_pump", "flow"]
    rows = [(START + dt.timedelta(hours=k), *[float(k)] * len(names)) for k in range(20)]
    df = spark.createDataFrame(rows, ["ts", *names])
    assert ingest.detect_tag_cols(df, "ts") == ["serial_pump", "flow"]


def test_headers_are_numbered(spark):
    df = spark.createDataFrame([(1,) * 5], ["a", " a", "b", "a ", "x"]).toDF("a", " a", "", "a ", "nan")
    assert ingest.normalize_headers(df).columns == ["a", "a_1", "Column_2", "a_2", "Column_4"]


def test_the_time_column_is_found_in_late_rows(spark):
    rows = [(None if k < 1500 else f"2024-01-{1 + k % 28:02d} 0{k % 10}:{k % 60:02d}", float(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "time_stamp string, x double").coalesce(1)
    assert ingest.detect_timestamp_col(df) == "time_stamp"


def test_groups_keep_their_limit(spark):
    tags = [f"g{k}" for k in range(9)] + ["s1", "s2", "s3"]
    rows = [(f"g{a}", f"g{b}", 0.9, 0.9) for a in range(9) for b in range(a + 1, 9)]
    rows += [(s, "g0", score, 0.1) for s, score in (("s1", 0.40), ("s2", 0.42), ("s3", 0.39))]
    rel = spark.createDataFrame(rows, "target string, source string, score double, best_r double")
    got = clusters.relation_communities(spark.createDataFrame([(t,) for t in tags], "tag string"), rel, most=10)
    sizes = {r["cluster_id"]: r["count"] for r in got.groupBy("cluster_id").count().collect()}
    assert sorted(sizes.values()) == [1, 1, 10]
    home = {r.tag: r.cluster_id for r in got.collect()}
    assert home["s2"] == home["g0"]


def test_pages_are_bounded_openly(spark):
    df = spark.range(30)
    assert [r.id for r in report.page(df, [F.col("id")], 10, 3).collect()] == list(range(20, 30))
    with pytest.raises(ValueError, match="1 to 500"):
        report.page(df, [F.col("id")], 501, 1)


def test_granger_lags_are_rows_of_the_pair(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal(120)
    y = np.concatenate([[0.0, 0.0], 0.5 * x[:-2]]) + rng.standard_normal(120)
    rows = []
    for k in range(120):
        at = START + dt.timedelta(hours=k)
        rows += [(at, "x", float(x[k]))] * (k % 9 != 0) + [(at, "y", float(y[k]))] * (k % 7 != 0) + [(at, "two", float(k % 2))]
    series = Series(spark.createDataFrame(rows, "ts timestamp_ntz, tag string, value double"))
    asked = spark.createDataFrame([("y", "x"), ("y", "two")], "target string, source string")
    got = pairs.granger(series, asked, 3).collect()
    assert [(r.target, r.source) for r in got] == [("y", "x")]
    kept = [k for k in range(120) if k % 9 and k % 7]
    a, b = x[kept], y[kept]
    best = None
    for lag in (1, 2, 3):
        n = len(a) - lag
        own = np.column_stack([np.ones(n), *[b[lag - j : len(b) - j] for j in range(1, lag + 1)]])
        full = np.column_stack([own, *[a[lag - j : len(a) - j] for j in range(1, lag + 1)]])
        rss = [float(((b[lag:] - m @ np.linalg.lstsq(m, b[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, full)]
        left = n - (2 * lag + 1)
        p = pairs.f_tail((rss[0] - rss[1]) / lag / (rss[1] / left), lag, left)
        best = min(best or (p, lag), (p, lag))
    assert got[0].p == pytest.approx(best[0], rel=1e-6) and got[0].granger_lag == best[1]
