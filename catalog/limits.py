"""Clean periods and per-tag limits."""

from pyspark.sql import functions as F

from catalog import sqlparts as sp
from catalog.base import HOURLY, SENSOR, SHIP, W, center_scale, query, r, rs
from sensorium.operators import clean, detect, limits, stats, windows
from sensorium.sources import shapes


@query("e29_stability_score", sp.joined(SHIP, sp.stability("ship")) + f" SELECT ts, {rs('score')} FROM sc")
def _(spark, folder):
    return clean.stability_score(shapes.ship_daily(spark, folder))


@query("e17_best_window", sp.joined(SHIP, sp.auto_clean("ship")) + f" SELECT ts, {rs('score')}, {r('rolling', 'rolling_score')}, clean FROM ac")
def _(spark, folder):
    return detect.auto_clean_rows(shapes.ship_daily(spark, folder))


@query(
    "e17_best_window_anchored",
    sp.joined(SHIP, sp.anchored("ship")) + f" SELECT ts, {rs('level_bad', 'jump_bad', 'score')}, {r('rolling', 'rolling_score')}, w AS window_rows, in_window AS clean FROM bw",
)
def _(spark, folder):
    return clean.anchored_window(shapes.ship_daily(spark, folder))


@query(
    "e30_clean_score_deviation",
    sp.joined(SHIP, sp.deviation_window("ship"))
    + f" SELECT ts, {rs('level_bad', 'spike_bad', 'change_bad', 'volatility_bad', 'present', 'score')}, in_window AS clean FROM bw",
)
def _(spark, folder):
    return clean.deviation_window(shapes.ship_daily(spark, folder)).drop("window_rows", "rolling_score")


@query(
    "e16_longest_stable_run",
    sp.joined(SHIP, sp.stable_run("ship")) + f" SELECT ts, {rs('level_bad', 'step_bad', 'score', 'cutoff')}, stable, run_length, clean FROM sr",
)
def _(spark, folder):
    return clean.longest_stable_run(shapes.ship_daily(spark, folder))


@query(
    "e30_stable_rows_for_bands",
    sp.joined(SHIP, sp.level_and_jump("ship"))
    + ", b0 AS (SELECT *, 0.75 * level_bad + 0.25 * jump_bad AS score FROM lj), b1 AS (SELECT *, (SELECT quantile_cont(score, 0.45) FROM b0) AS cutoff FROM b0) "
    + f"SELECT ts, {rs('level_bad', 'jump_bad', 'score', 'cutoff')}, score <= cutoff AS stable FROM b1",
)
def _(spark, folder):
    return clean.stable_rows_for_bands(shapes.ship_daily(spark, folder))


@query(
    "e31_stable_rows",
    sp.joined(HOURLY, center_scale("hourly", "value", "c"), "tagn AS (SELECT count(DISTINCT tag) AS tn FROM hourly)")
    + f", x AS (SELECT ts, count(*) FILTER (abs((value - center) / scale) > 3.5) / max(tn) AS bad_fraction FROM hourly JOIN c USING (tag), tagn GROUP BY ts) "
    f"SELECT ts, {rs('bad_fraction')}, bad_fraction <= 0.20 AS stable FROM x",
)
def _(spark, folder):
    return clean.stable_rows(shapes.sensor_hourly(spark, folder))


@query(
    "d5_clean_limits",
    sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac"))
    + f" SELECT tag, {rs('center', 'scale')}, baseline_count, clean_count, {rs('clean_min', 'clean_max')}, fallback_used FROM lim",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return limits.clean_limits(s, detect.auto_clean_rows(s))


@query(
    "d6_threshold_columns",
    sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac"))
    + " SELECT tag, "
    + ", ".join(
        r(f"center {sign} {z} * scale", f"{name}_{side}_limit")
        for name, z in (("drift", 3), ("drift_anomaly", 3.5), ("strong_anomaly", 5))
        for sign, side in (("-", "lower"), ("+", "upper"))
    )
    + " FROM lim",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    table = limits.fences(limits.clean_limits(s, detect.auto_clean_rows(s)), F.lit(3.0), F.lit(3.5), F.lit(5.0))
    return table.select("tag", *[c for c in table.columns if c.endswith("_limit")])


_CLEAN_Z = (
    sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac"))
    + ", zz AS (SELECT s.tag, abs((value - center) / scale) AS z FROM ship s JOIN ac USING (ts) JOIN lim USING (tag) WHERE clean)"
)


@query(
    "d7_auto_thresholds",
    _CLEAN_Z
    + ", q AS (SELECT quantile_cont(z, 0.995) AS a, quantile_cont(z, 0.999) AS b, quantile_cont(z, 0.9995) AS c FROM zz), "
    "t AS (SELECT greatest(3.0, a) AS a, b, c FROM q), t2 AS (SELECT a, greatest(a + 0.5, b) AS b, c FROM t) "
    "SELECT round(a, 3) AS drift_z, round(b, 3) AS drift_anomaly_z, round(greatest(b + 1.0, c), 3) AS strong_anomaly_z FROM t2",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    rows = detect.auto_clean_rows(s)
    return limits.auto_thresholds(s, rows, limits.clean_limits(s, rows))


_ADAPT = (
    ", q AS (SELECT tag, quantile_cont(z, 0.995) AS a, quantile_cont(z, 0.999) AS b, quantile_cont(z, 0.9995) AS c FROM zz GROUP BY tag), "
    "t AS (SELECT tag, greatest(2.4, a) AS a, b, c FROM q), t2 AS (SELECT tag, a, greatest(a + 0.35, b) AS b, c FROM t), "
    "t3 AS (SELECT tag, round(least(a, 12.0), 4) AS dz, round(least(b, 14.0), 4) AS az, round(least(greatest(b + 0.6, c), 16.0), 4) AS sz FROM t2), "
    "ad AS (SELECT lim.*, coalesce(dz, 3.0) AS dz, coalesce(az, 3.5) AS az, coalesce(sz, 5.0) AS sz FROM lim LEFT JOIN t3 USING (tag))"
)


@query(
    "d8_adaptive_thresholds",
    _CLEAN_Z + _ADAPT
    + f" SELECT tag, dz AS drift_z, az AS drift_anomaly_z, sz AS strong_anomaly_z, {r('center - dz * scale', 'drift_lower_limit')}, {r('center + sz * scale', 'strong_anomaly_upper_limit')} FROM ad",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    rows = detect.auto_clean_rows(s)
    table = limits.adaptive_thresholds(s, rows, limits.clean_limits(s, rows))
    return table.select("tag", "drift_z", "drift_anomaly_z", "strong_anomaly_z", "drift_lower_limit", "strong_anomaly_upper_limit")


_HYBRID = (
    ", hy AS (SELECT s.tag, count(*) AS n, median(value) AS med, stddev_samp(value) AS std, mad(value) AS mad, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr "
    "FROM ship s JOIN ac USING (ts) WHERE clean GROUP BY s.tag), hl AS (SELECT tag, 0.5 * center + 0.5 * med AS center, "
    "greatest(scale, CASE WHEN mad < 1e-12 THEN coalesce(std, 0) ELSE 1.4826 * mad END, CASE WHEN iqr > 1e-12 THEN iqr / 1.349 ELSE 0 END, coalesce(std, 0), 1e-9) AS scale "
    "FROM lim JOIN hy USING (tag))"
)


@query("d9_hybrid_limits", sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac")) + _HYBRID + f" SELECT tag, {rs('center', 'scale')} FROM hl")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    rows = detect.auto_clean_rows(s)
    return limits.hybrid_limits(s, rows, limits.clean_limits(s, rows)).select("tag", "center", "scale")


_BAND_COLS = f"tag, reference_count, {rs('reference_mean', 'reference_median', 'reference_std', 'reference_scale', 'lower_limit', 'upper_limit')}"
_BAND_NAMES = ["tag", "reference_count", "reference_mean", "reference_median", "reference_std", "reference_scale", "lower_limit", "upper_limit"]


@query("d10_similar_history_limits", sp.joined(SHIP, sp.anchored("ship"), sp.similar_history("ship")) + f" SELECT {_BAND_COLS} FROM band")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return limits.similar_history_limits(s, clean.anchored_window(s)).select(*_BAND_NAMES)


@query("d11_clean_window_limits", sp.joined(SHIP, sp.anchored("ship"), sp.clean_only("ship")) + f" SELECT {_BAND_COLS} FROM band")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return limits.clean_window_limits(s, clean.anchored_window(s)).select(*_BAND_NAMES)


@query("d12_spike_free_limits", sp.joined(SHIP, sp.deviation_window("ship"), sp.spike_free("ship")) + f" SELECT {_BAND_COLS} FROM band")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    features = windows.deviation_features(s)
    return limits.spike_free_limits(s, features, clean.deviation_window(s, features))[0].select(*_BAND_NAMES)


_LIKE = ["central_lower", "central_upper", "clean_median", "clean_scale", "delta_center", "delta_scale", "abs_error_center", "abs_error_scale"]


@query(
    "d13_clean_like_limits",
    sp.joined(SHIP, sp.stable_run("ship"), sp.clean_like("ship")) + f" SELECT {_BAND_COLS}, clean_count, {rs(*_LIKE)} FROM cl",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return limits.clean_like_limits(s, clean.longest_stable_run(s)).select(*_BAND_NAMES, "clean_count", *_LIKE)


@query(
    "d15_value_bands",
    sp.joined(SHIP, sp.bands("ship"))
    + f" SELECT tag, band_id, band_count, {rs('band_fraction', 'band_median', 'band_scale', 'q01', 'q05', 'q95', 'q99', 'lower_limit', 'upper_limit')} FROM bd",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return limits.value_bands(s, clean.stable_rows_for_bands(s))


@query(
    "c14_nearest_band",
    sp.joined(SHIP, sp.bands("ship"), sp.nearest("ship")) + f" SELECT ts, tag, {rs('value')}, band_id, {r('dist', 'band_distance_z')}, {rs('lower_limit', 'upper_limit')} FROM nb",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    df = detect.nearest_band(s, limits.value_bands(s, clean.stable_rows_for_bands(s)))
    return df.select("ts", "tag", "value", "band_id", "band_distance_z", "lower_limit", "upper_limit")


def baseline_sql(src: str, trim: str | None) -> str:
    """CTE ``bl``: consensus baseline per tag."""
    t = trim or "0"
    lvl = "CASE WHEN NOT trim_it OR a BETWEEN lo AND hi THEN a END" if trim else "a"
    stp = "CASE WHEN NOT trim_d OR delta BETWEEN dlo AND dhi THEN delta END" if trim else "delta"
    return ", ".join(
        [
            f"y0 AS (SELECT *, value - lag(value) OVER ({W}) AS delta FROM {src})",
            center_scale("y0", "value", "yf", "floor"),
            "y1 AS (SELECT y0.*, n AS cnt, greatest(1e-9, 0.1 * greatest(scale, 1e-9)) AS off_floor FROM y0 JOIN yf USING (tag))",
            "y2 AS (SELECT tag, count_if(abs(value) <= off_floor) / count(value) >= 0.05 AS off_mode, count_if(abs(value) > off_floor) AS onn, count(delta) AS dn FROM y1 GROUP BY tag)",
            "y3 AS (SELECT y1.*, off_mode, dn, CASE WHEN off_mode AND onn > 0 AND abs(value) <= off_floor THEN NULL ELSE value END AS a FROM y1 JOIN y2 USING (tag))",
            f"y4 AS (SELECT tag, quantile_cont(a, {t}) AS lo, quantile_cont(a, 1 - {t}) AS hi, quantile_cont(delta, {t}) AS dlo, quantile_cont(delta, 1 - {t}) AS dhi FROM y3 GROUP BY tag)",
            "y5 AS (SELECT y3.*, lo, hi, dlo, dhi FROM y3 JOIN y4 USING (tag))",
            "y6 AS (SELECT tag, count(a) >= 10 AND count_if(a BETWEEN lo AND hi) >= greatest(25, least(100, floor(any_value(cnt) * 0.35))) AS trim_it, "
            "count(delta) >= 10 AND count_if(delta BETWEEN dlo AND dhi) >= greatest(25, least(80, any_value(dn) // 3)) AS trim_d FROM y5 GROUP BY tag)",
            f"y7 AS (SELECT y5.*, {lvl} AS level_v, {stp} AS step_v FROM y5 JOIN y6 USING (tag))",
            center_scale("y7", "level_v", "yl", "floor"),
            center_scale("y7", "step_v", "ys", "floor"),
            "yq AS (SELECT tag, quantile_cont(level_v, 0.25) AS q1, quantile_cont(level_v, 0.75) AS q3, any_value(cnt) AS cnt, any_value(off_floor) AS off_floor, any_value(off_mode) AS off_mode FROM y7 GROUP BY tag)",
            "bl AS (SELECT tag, yl.center AS median, yl.scale AS mad_scale, q1, q3, CASE WHEN q3 - q1 <= 0 THEN yl.scale ELSE q3 - q1 END AS iqr, coalesce(ys.scale, 1e-9) AS diff_scale, "
            "cnt AS count, off_floor, off_mode FROM yl JOIN ys USING (tag) JOIN yq USING (tag))",
        ]
    )


_BL = f" SELECT tag, {rs('median', 'mad_scale', 'q1', 'q3', 'iqr', 'diff_scale')}, count, {rs('off_floor')}, off_mode FROM bl"


@query("d4_consensus_baseline", sp.joined(SHIP, baseline_sql("ship", "0.15")) + _BL, digits=5)
def _(spark, folder):
    return limits.consensus_baseline(shapes.ship_daily(spark, folder), 0.15)


@query("d4_consensus_baseline_untrimmed", sp.joined(SENSOR, baseline_sql("sensor", None)) + _BL)
def _(spark, folder):
    return limits.consensus_baseline(shapes.sensor_long(spark, folder), 0.0)


@query(
    "d54_display_limits",
    sp.joined(SHIP, baseline_sql("ship", "0.15"))
    + f" SELECT tag, {r('median', 'baseline_center')}, {r('mad_scale', 'baseline_scale')}, {r('median - 3.75 * mad_scale', 'drift_lower_limit')}, {r('median + 3.75 * mad_scale', 'drift_upper_limit')}, "
    f"{r('least(median - 4.6875 * mad_scale, q1 - 2.75 * iqr)', 'strong_anomaly_lower_limit')}, {r('greatest(median + 4.6875 * mad_scale, q3 + 2.75 * iqr)', 'strong_anomaly_upper_limit')} FROM bl",
    digits=5,
)
def _(spark, folder):
    return limits.display_limits(limits.consensus_baseline(shapes.ship_daily(spark, folder), 0.15), 3.75, 2.75)


@query(
    "d54_percentile_display_limits",
    f"WITH {SHIP}, q AS (SELECT tag, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM ship GROUP BY tag) "
    f"SELECT tag, {r('(p05 + p95) / 2', 'baseline_center')}, {r('CASE WHEN p95 > p05 THEN greatest((p95 - p05) / 3.5, 1e-9) ELSE 1e-9 END', 'baseline_scale')}, "
    f"{r('p05', 'drift_lower_limit')}, {r('p95', 'drift_upper_limit')}, {r('p01', 'strong_anomaly_lower_limit')}, {r('p99', 'strong_anomaly_upper_limit')} FROM q",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return limits.percentile_display_limits(stats.reference_profile(s, s.df))
