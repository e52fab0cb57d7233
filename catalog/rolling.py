"""The rolling detector: SQL states the frame's vote with windows that end at each reading."""

from pyspark.sql import functions as F

from catalog import sqlparts as sp
from catalog.base import SENSOR, W, query, r, rs
from sensorium.operators import rolling
from sensorium.sources import shapes


def _med(x: str) -> str:
    return f"list_median({x})"


def _mad(x: str) -> str:
    return f"list_median(list_transform({x}, lambda z : abs(z - list_median({x}))))"


# A frame of 31 readings is never trimmed: its inner part would be too small. Its centred windows of 31 are cut at the frame's end.
_FRAMES = (
    f"o AS (SELECT *, row_number() OVER ({W}) AS pos FROM sensor), "
    "f AS (SELECT ts, row_index, tag, value, pos, list(value) OVER (PARTITION BY tag ORDER BY pos ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS x, "
    "avg(value) OVER (PARTITION BY tag ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS bm, stddev_pop(value) OVER (PARTITION BY tag ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS bs FROM o), "
    f"g AS (SELECT *, {_med('x')} AS med0, greatest(1.4826 * {_mad('x')}, 1e-9) AS sc0, list_transform(range(2, 32), lambda i : x[i] - x[i - 1]) AS dx FROM f WHERE pos > 30), "
    "h AS (SELECT *, greatest(1e-9, 0.1 * greatest(sc0, 1e-9)) AS fl FROM g), "
    "i AS (SELECT *, len(list_filter(x, lambda z : abs(z) <= fl)) >= 0.05 * 31 AS off, CASE WHEN len(list_filter(x, lambda z : abs(z) <= fl)) >= 0.05 * 31 AND len(list_filter(x, lambda z : abs(z) > fl)) > 0 THEN list_filter(x, lambda z : abs(z) > fl) ELSE x END AS a FROM h), "
    f"j AS (SELECT *, {_med('a')} AS med, greatest(1.4826 * {_mad('a')}, 1e-9) AS sc, list_aggregate(a, 'quantile_cont', 0.25) AS q1, list_aggregate(a, 'quantile_cont', 0.75) AS q3, greatest(1.4826 * {_mad('dx')}, 1e-9) AS ds, "
    # medians of the centred windows around the places 14 to 31
    f"list_transform(range(1, 32), lambda k : {_med('x[greatest(1, k - 15):least(31, k + 15)]')}) AS lm FROM i), "
    "k AS (SELECT *, CASE WHEN q3 - q1 <= 0 THEN sc ELSE q3 - q1 END AS iqr, list_transform(range(1, 32), lambda k : abs(x[k] - lm[k])) AS ld FROM j), "
    f"l AS (SELECT *, list_transform([29, 30, 31], lambda k : greatest(1.4826 * {_med('ld[greatest(1, k - 15):least(31, k + 15)]')}, 1e-9)) AS ls FROM k), "
    "m AS (SELECT *, list_transform([29, 30, 31], lambda k : CASE WHEN off AND abs(x[k]) <= fl THEN 0 ELSE "
    "CASE WHEN sc > 1e-9 AND abs(x[k] - med) / sc >= 3.75 THEN 1 ELSE 0 END + CASE WHEN abs(x[k] - lm[k]) / ls[k - 28] >= 3.75 THEN 1 ELSE 0 END + "
    "CASE WHEN iqr > 0 AND (x[k] < q1 - 2.75 * iqr OR x[k] > q3 + 2.75 * iqr) THEN 1 ELSE 0 END + CASE WHEN ds > 1e-9 AND abs(dx[k - 1]) / ds >= 4.5 THEN 1 ELSE 0 END END) AS fired FROM l), "
    "n AS (SELECT *, CASE WHEN off AND abs(value) <= fl THEN 'Normal' WHEN fired[3] >= 3 THEN CASE WHEN len(list_filter(fired, lambda z : z >= 2)) <= 1 AND fired[3] < 4 THEN 'Warning' ELSE 'Actual Outlier' END WHEN fired[3] >= 2 THEN 'Warning' ELSE 'Normal' END AS final_class FROM m)"
)


@query(
    "i21_detect_rolling",
    sp.joined(SENSOR, _FRAMES)
    + f" SELECT ts, row_index, tag, {rs('value')}, {r('bm', 'baseline_mean')}, {r('bs', 'baseline_std')}, round(bm - 3.75 * bs, 5) + 0.0 AS lower_limit, CAST(fired[3] AS BIGINT) AS signals_fired, final_class, CASE WHEN final_class = 'Normal' THEN 'Normal' ELSE 'Outlier' END AS status FROM n",
)
def _(spark, folder):
    df = rolling.rolling_consensus(shapes.sensor_long(spark, folder))
    return df.select("ts", "row_index", "tag", "value", "baseline_mean", "baseline_std", F.round("lower_limit", 5).alias("lower_limit"), "signals_fired", "final_class", "status")
