"""Single-tag detectors."""

from pyspark.sql import functions as F

from catalog import sqlparts as sp
from catalog.base import SENSOR, SHIP, USER, W, center_scale, query, r, rs
from catalog.limits import _ADAPT, _CLEAN_Z, _HYBRID
from catalog.windows import runs_sql
from sensorium.operators import detect
from sensorium.sources import shapes

_SIMPLE = (
    f"{USER}, m AS (SELECT tag, CASE WHEN count(value) >= 5 AND mad(value) > 0 THEN 1.4826 * mad(value) + 1e-12 END AS s, median(value) AS c FROM users GROUP BY tag), "
    "fl AS (SELECT ts, u.tag, value, (value - c) / s AS robust_z FROM users u JOIN m USING (tag) WHERE abs((value - c) / s) > 3.5)"
)


@query("i1_simple_robust", f"WITH {_SIMPLE} SELECT ts, tag, {rs('value', 'robust_z')} FROM fl")
def _(spark, folder):
    return detect.simple_robust(shapes.user_long(spark, folder)).select("ts", "tag", "value", "robust_z")


@query(
    "i1_simple_status",
    f"WITH {_SIMPLE}, g AS (SELECT tag, min(ts) AS first_outlier_ts, count(*) AS n FROM fl GROUP BY tag) "
    "SELECT t.tag, coalesce(n, 0) > 0 AS is_outlier, first_outlier_ts, coalesce(n, 0) AS num_flags FROM (SELECT DISTINCT tag FROM users) t LEFT JOIN g USING (tag)",
)
def _(spark, folder):
    return detect.simple_status(shapes.user_long(spark, folder))


_LABELS = (
    f"WITH {SHIP}, {center_scale('ship', 'value', 'c', 'unit', '1e-300')}, "
    f"z AS (SELECT s.*, (value - center) / scale AS z_score, abs(value - lag(value) OVER ({W})) AS ad, "
    "count(value) OVER f = 5 AND min(value) OVER f = max(value) OVER f AS flatline FROM ship s JOIN c USING (tag) "
    "WINDOW f AS (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
    "sd AS (SELECT tag, stddev_samp(ad) AS sd FROM z GROUP BY tag), "
    "k AS (SELECT z.*, coalesce(ad > 3 * sd, FALSE) AS jump FROM z JOIN sd USING (tag)) "
    f"SELECT ts, tag, {rs('value', 'z_score')}, flatline, jump, CASE WHEN value IS NULL THEN 'missing' WHEN abs(z_score) > 5 THEN 'strong_outlier' "
    "WHEN abs(z_score) > 3 THEN 'mild_outlier' WHEN flatline THEN 'flatline' WHEN jump THEN 'sudden_jump' ELSE 'normal' END AS status FROM k"
)


@query("i2_status_labels", _LABELS)
def _(spark, folder):
    """Labels without the isolation step."""
    return detect.status_labels(shapes.ship_daily(spark, folder))


_UNIT = "(('0x' || substr(md5('42:' || tree || ':' || level || ':' || (c - 1)), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
_ISOLATION = (
    "en(tree, level, ends) AS (SELECT tree, 0, [0.0::DOUBLE, 1.0::DOUBLE] FROM (SELECT unnest(range(0, 50)) AS tree) UNION ALL "
    f"SELECT tree, level + 1, list_append(flatten(list_transform(range(1, len(ends)), lambda c : [ends[c], ends[c] + (ends[c + 1] - ends[c]) * {_UNIT}])), 1.0::DOUBLE) FROM en WHERE level < 8), "
    "lf AS (SELECT tree, unnest(range(0, 256)) AS leaf, unnest(list_prepend(-1.0::DOUBLE, ends[2:256])) AS lo, unnest(ends[2:]) AS hi FROM en WHERE level = 8), "
    "mm AS (SELECT tag, min(value) AS lo, max(value) AS hi FROM sensor GROUP BY tag), "
    "sh AS (SELECT s.*, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END AS share FROM sensor s JOIN mm USING (tag) WHERE value IS NOT NULL), "
    "pl AS (SELECT ts, row_index, tag, value, tree, leaf FROM sh JOIN lf ON share > lf.lo AND share <= lf.hi), "
    "ct AS (SELECT tag, tree, leaf, count(*) AS n FROM pl GROUP BY ALL), "
    "lv AS (SELECT tag, tree, leaf, n, level, sum(n) OVER (PARTITION BY tag, tree, level, leaf // (2 ** (8 - level))::BIGINT) AS whole FROM ct, (SELECT unnest(range(0, 9)) AS level)), "
    "dp AS (SELECT tag, tree, leaf, coalesce(min(level) FILTER (whole <= 1), 8 + CASE WHEN max(n) > 1 THEN 2 * (ln(max(n) - 1) + 0.5772156649015329) - 2 * (max(n) - 1) / max(n) ELSE 0 END) AS depth FROM lv GROUP BY ALL), "
    "iso AS (SELECT ts, row_index, tag, any_value(value) AS value, round(avg(depth::DOUBLE), 9) AS depth FROM pl JOIN dp USING (tag, tree, leaf) GROUP BY ts, row_index, tag), "
    "ic AS (SELECT tag, round(quantile_cont(depth, 0.02), 9) AS cut FROM iso GROUP BY tag), "
    "io AS (SELECT iso.*, depth < cut AS isolated FROM iso JOIN ic USING (tag))"
)


@query("i2b_tail_isolation", f"WITH RECURSIVE {SENSOR}, {_ISOLATION} SELECT ts, tag, {rs('value')}, round(depth, 6) + 0.0 AS isolation_depth, isolated FROM io")
def _(spark, folder):
    df = detect.tail_isolation(shapes.sensor_long(spark, folder))
    return df.select("ts", "tag", "value", "isolation_depth", "isolated")


_LABELS_ISO = (
    _LABELS.replace("WITH ", "WITH RECURSIVE ", 1).replace(SHIP, f"{SENSOR}, {_ISOLATION}").replace("FROM ship s", "FROM sensor s").replace(center_scale("ship", "value", "c", "unit", "1e-300"), center_scale("sensor", "value", "c", "unit", "1e-300"))
    .replace("SELECT ts, tag,", "SELECT k.ts, k.tag,").replace(rs("value", "z_score"), "round(k.value, 6) + 0.0 AS value, round(z_score, 6) + 0.0 AS z_score")
    .replace("ELSE 'normal'", "WHEN isolated THEN 'isolation_outlier' ELSE 'normal'").replace("WHEN value IS NULL", "WHEN k.value IS NULL").replace("AS status FROM k", "AS status FROM k LEFT JOIN io ON io.tag = k.tag AND io.ts = k.ts AND io.row_index = k.row_index")
)


@query("i2_status_labels_isolation", _LABELS_ISO)
def _(spark, folder):
    s = shapes.sensor_long(spark, folder)
    return detect.status_labels(s, detect.tail_isolation(s))


_CLS = f" SELECT ts, tag, {rs('value', 'value_z')}, final_class, final_status, direction, limit_crossed FROM cls"
_CLS_NAMES = ["ts", "tag", "value", "value_z", "final_class", "final_status", "direction", "limit_crossed"]


@query("i3_auto_clean", sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac"), sp.z_classes("ship", "lim")) + _CLS)
def _(spark, folder):
    return detect.auto_clean(shapes.ship_daily(spark, folder)).select(*_CLS_NAMES)


_ALL = "ac AS (SELECT DISTINCT ts, TRUE AS clean FROM sensor)"


@query("i4_all_rows_baseline", sp.joined(SENSOR, _ALL, sp.clean_limits("sensor", "ac"), sp.z_classes("sensor", "lim")) + _CLS)
def _(spark, folder):
    return detect.all_rows_baseline(shapes.sensor_long(spark, folder)).select(*_CLS_NAMES)


@query("i5_adaptive", _CLEAN_Z + _ADAPT + ", " + sp.z_classes("ship", "ad", "dz", "az", "sz").replace("dz AS dz, az AS az, sz AS sz", "dz, az, sz") + _CLS)
def _(spark, folder):
    return detect.adaptive(shapes.ship_daily(spark, folder)).select(*_CLS_NAMES)


_HYB = (
    sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac"))
    + _HYBRID
    + ", zz AS (SELECT s.tag, abs((value - center) / scale) AS z FROM ship s JOIN ac USING (ts) JOIN hl USING (tag) WHERE clean)"
    + _ADAPT.replace("lim.*", "hl.*").replace("FROM lim", "FROM hl")
)


@query("i5_adaptive_hybrid", _HYB + ", " + sp.z_classes("ship", "ad", "dz", "az", "sz").replace("dz AS dz, az AS az, sz AS sz", "dz, az, sz") + _CLS)
def _(spark, folder):
    return detect.adaptive(shapes.ship_daily(spark, folder), hybrid=True).select(*_CLS_NAMES)


_OUT = f" SELECT ts, tag, {rs('value', 'lower_limit', 'upper_limit', 'distance_z')}, raw_outside, persistent_outside, final_class FROM cls"
_OUT_NAMES = ["ts", "tag", "value", "lower_limit", "upper_limit", "distance_z", "raw_outside", "persistent_outside", "final_class"]


@query("i6_clean_window", sp.joined(SHIP, sp.anchored("ship"), sp.clean_only("ship"), sp.outside_band("ship")) + _OUT)
def _(spark, folder):
    return detect.clean_window(shapes.ship_daily(spark, folder)).select(*_OUT_NAMES)


@query("i7_clean_anchored", sp.joined(SHIP, sp.anchored("ship"), sp.similar_history("ship"), sp.outside_band("ship")) + _OUT)
def _(spark, folder):
    return detect.clean_anchored(shapes.ship_daily(spark, folder)).select(*_OUT_NAMES)


_F3 = "OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(
    "i8_deviation_spike",
    sp.joined(SHIP, sp.deviation_window("ship"), sp.spike_free("ship"))
    + ", w0 AS (SELECT v2.ts, v2.row_index, v2.tag, v2.value, spike_z, change_z, is_reference, (value - reference_median) / reference_scale AS value_z, "
    "coalesce(value < lower_limit OR value > upper_limit, FALSE) AS lvl FROM v2 JOIN band USING (tag)), "
    f"w1 AS (SELECT *, sum(CAST(lvl AS INT)) {_F3} >= 2 AS pers, abs(spike_z) > 4 OR abs(change_z) > 4 AS shaky FROM w0) "
    f"SELECT ts, tag, {rs('value', 'value_z', 'spike_z', 'change_z')}, is_reference, lvl AS is_level_outlier, pers AS persistent_outlier, "
    "CASE WHEN value IS NULL THEN 'Unknown' WHEN NOT lvl THEN 'Normal' WHEN abs(value_z) >= 5 OR abs(spike_z) >= 5 OR abs(change_z) >= 5 THEN 'Strong Anomaly' "
    "WHEN NOT pers THEN CASE WHEN shaky THEN 'Drift + Anomaly' ELSE 'Normal' END WHEN abs(value_z) < 3.75 THEN 'Drift' ELSE 'Drift + Anomaly' END AS final_class FROM w1",
)
def _(spark, folder):
    df = detect.deviation_spike(shapes.ship_daily(spark, folder))
    return df.select("ts", "tag", "value", "value_z", "spike_z", "change_z", "is_reference", "is_level_outlier", "persistent_outlier", "final_class")


def deviation_inside_sql(src: str) -> str:
    """CTE ``v5``: the in-limit detector; needs ``jd`` and ``cl``."""
    return ", ".join(
        [
            "i0 AS (SELECT jd.*, cl.* EXCLUDE (tag), value - reference_median AS error, (value - reference_median) / reference_scale AS value_z, "
            "(coalesce(delta, 0.0) - delta_center) / delta_scale AS delta_z, (abs(value - reference_median) - abs_error_center) / abs_error_scale AS dev_z, "
            "coalesce(value BETWEEN lower_limit AND upper_limit, FALSE) AS within FROM jd JOIN cl USING (tag))",
            "i1 AS (SELECT *, NOT within AS outside, within AND abs(delta_z) >= 4 AS spike, within AND NOT coalesce(value BETWEEN central_lower AND central_upper, FALSE) AND dev_z >= 3 AS dev FROM i0)",
            runs_sql("i1", "outside", "i2", "orun"),
            runs_sql("i2", "dev", "i3", "drun"),
            "v5 AS (SELECT *, CASE WHEN outside THEN CASE WHEN value_z IS NULL THEN 'Unknown' WHEN abs(value_z) >= 7 THEN 'Strong Anomaly' WHEN orun >= 2 AND abs(value_z) < 4.5 THEN 'Drift' ELSE 'Drift + Anomaly' END "
            "WHEN spike THEN 'Drift + Anomaly' WHEN drun >= 2 THEN 'Drift' ELSE 'Normal' END AS final_class, "
            "coalesce(nullif(concat_ws(' + ', CASE WHEN outside THEN 'Outside Limit' END, CASE WHEN spike THEN 'Within Limit Spike' END, CASE WHEN spike THEN 'Within Limit Error Change' END, "
            "CASE WHEN drun >= 2 THEN 'Within Limit Persistent Deviation' END), ''), 'Normal') AS outlier_type FROM i3)",
        ]
    )


@query(
    "i9_deviation_inside",
    sp.joined(SHIP, sp.stable_run("ship"), sp.clean_like("ship"), deviation_inside_sql("ship"))
    + f" SELECT ts, tag, {rs('value', 'value_z', 'delta_z')}, {r('dev_z', 'deviation_z')}, orun AS outside_run, drun AS deviation_run, outlier_type, final_class FROM v5",
)
def _(spark, folder):
    df = detect.deviation_inside(shapes.ship_daily(spark, folder))
    return df.select("ts", "tag", "value", "value_z", "delta_z", "deviation_z", "outside_run", "deviation_run", "outlier_type", "final_class")


@query(
    "i10_regime_bands",
    sp.joined(SHIP, sp.bands("ship"), sp.nearest("ship"))
    + ", g0 AS (SELECT *, NOT coalesce(value BETWEEN lower_limit AND upper_limit, FALSE) AS outside FROM nb), "
    f"g1 AS (SELECT *, sum(CAST(outside AS INT)) {_F3} >= 2 AS pers FROM g0) "
    f"SELECT ts, tag, {rs('value')}, band_id, {r('dist', 'band_distance_z')}, pers AS persistent_outside, CASE WHEN NOT (abs(dist) >= 5 OR (outside AND pers)) THEN 'Normal' "
    "WHEN abs(dist) >= 5 THEN 'Strong Anomaly' WHEN NOT pers OR abs(dist) < 3 THEN 'Normal' WHEN abs(dist) < 3.5 THEN 'Drift' ELSE 'Drift + Anomaly' END AS final_class FROM g1",
)
def _(spark, folder):
    df = detect.regime_bands(shapes.ship_daily(spark, folder))
    return df.select("ts", "tag", "value", "band_id", "band_distance_z", "persistent_outside", "final_class")


@query(
    "i22_classify_points_simple",
    f"WITH {SHIP}, m AS (SELECT tag, avg(value) AS m, stddev_pop(value) AS s FROM ship GROUP BY tag), "
    "z AS (SELECT ts, tag, value, m, s, CASE WHEN s > 0 THEN (value - m) / s ELSE 0.0 END AS z FROM ship JOIN m USING (tag)), "
    "p AS (SELECT ts, count_if(abs(z) > 2) AS peers, list(tag ORDER BY tag) AS moved FROM z WHERE abs(z) >= 2 GROUP BY ts), "
    "k AS (SELECT z.*, coalesce(peers, 0) AS n, list_filter(coalesce(moved, []), lambda x: x <> z.tag)[1:5] AS related_tags FROM z LEFT JOIN p USING (ts)), "
    "s AS (SELECT *, abs(z) >= 2.5 AS o, (n >= 2 AND abs(z) >= 1.5) OR (tag = 'qty_sum' AND abs(z) >= 2) AS pr, round(abs(z), 2) AS os, "
    "round(least(CAST(5.0 AS DOUBLE), CAST(n * 1.2 + CASE WHEN tag = 'qty_sum' THEN 0.5 ELSE 0 END AS DOUBLE)), 2) AS ps FROM k) "
    f"SELECT tag, ts, {rs('value')}, CASE WHEN o AND pr THEN 'Both' WHEN o THEN 'Outlier Only' ELSE 'Process Issue Only' END AS status, os AS outlier_score, ps AS process_issue_score, "
    f"{r('m - 2.5 * s', 'lower_limit')}, {r('m + 2.5 * s', 'upper_limit')}, related_tags, CASE WHEN greatest(os, ps) >= 4 THEN 'High' WHEN greatest(os, ps) >= 2.5 THEN 'Medium' ELSE 'Low' END AS severity FROM s WHERE o OR pr",
)
def _(spark, folder):
    return detect.classify_points_simple(shapes.ship_daily(spark, folder), ("qty_sum",))
