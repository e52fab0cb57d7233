"""Window operators per tag."""

from pyspark.sql import functions as F

from catalog.base import HOURLY, ORDERS, SENSOR, SHIP, USER, W, center_scale, query, r, rs
from sensorium.operators import stats, windows
from sensorium.sources import shapes

_DIFF = f"d AS (SELECT *, value - lag(value) OVER ({W}) AS delta FROM sensor)"


@query(
    "e1_diff_delta_z",
    f"WITH {SENSOR}, {_DIFF}, {center_scale('d', 'delta', 'c', 'floor')} "
    f"SELECT ts, d.tag, {rs('value', 'delta')}, {r('scale', 'delta_scale')}, {r('delta / scale', 'delta_z')} FROM d JOIN c USING (tag)",
)
def _(spark, folder):
    return windows.delta_z(shapes.sensor_long(spark, folder)).select("ts", "tag", "value", "delta", "delta_scale", "delta_z")


def _local(src: str, back: int, ahead: int, need: int) -> str:
    f = f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return (
        f"m AS (SELECT *, CASE WHEN count(value) {f} >= {need} THEN quantile_cont(value, 0.5) {f} END AS med FROM {src}), "
        f"d2 AS (SELECT *, abs(value - med) AS dev FROM m), "
        f"l AS (SELECT *, CASE WHEN count(dev) {f} >= {need} THEN greatest(1.4826 * quantile_cont(dev, 0.5) {f}, 1e-9) END AS scale FROM d2)"
    )


@query(
    "e2_centered_median_mad",
    f"WITH {SENSOR}, {_local('sensor', 15, 15, 11)} SELECT ts, tag, {rs('value')}, {r('med', 'local_median')}, "
    f"{r('scale', 'local_scale')}, {r('(value - med) / scale', 'z_local')} FROM l",
    digits=8,
)
def _(spark, folder):
    df = windows.centered_median_mad(shapes.sensor_long(spark, folder))
    return df.select("ts", "tag", "value", "local_median", "local_scale", "z_local")


@query(
    "e3_trailing_regime_z",
    f"WITH {SENSOR}, {_local('sensor', 71, 0, 24)} SELECT ts, tag, {rs('value')}, {r('med', 'long_median')}, "
    f"{r('scale', 'long_scale')}, {r('(value - med) / scale', 'z_long')} FROM l",
    digits=8,
)
def _(spark, folder):
    df = windows.trailing_regime_z(shapes.sensor_long(spark, folder))
    return df.select("ts", "tag", "value", "long_median", "long_scale", "z_long")


def _trail(n: int, need: int) -> str:
    f = f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(value) {f} >= {need} THEN quantile_cont(value, 0.5) {f} END"


_GAP = f"g AS (SELECT *, {_trail(9, 4)} - {_trail(72, 24)} AS gap FROM sensor)"


@query(
    "e4_trend_gap_z",
    f"WITH {SENSOR}, {_GAP}, {center_scale('g', 'gap', 'c', 'floor')} SELECT ts, g.tag, {rs('value', 'gap')}, "
    f"{r('CASE WHEN scale > 1e-9 THEN gap / scale END', 'z_gap')} FROM g JOIN c USING (tag)",
)
def _(spark, folder):
    return windows.trend_gap_z(shapes.sensor_long(spark, folder)).select("ts", "tag", "value", "gap", "z_gap")


_EARLY = (
    f"p AS (SELECT *, row_number() OVER ({W}) AS pos, count(*) OVER (PARTITION BY tag) AS cnt FROM sensor), "
    "e0 AS (SELECT *, CASE WHEN cnt >= 50 AND pos <= least(greatest(40, floor(cnt * 0.28)), cnt - 1) THEN value END AS early FROM p)"
)


@query(
    "e5_early_segment_z",
    f"WITH {SENSOR}, {_EARLY}, {center_scale('e0', 'early', 'c', 'floor')} SELECT ts, e0.tag, {rs('value')}, "
    f"{r('CASE WHEN n >= 30 AND scale > 1e-9 THEN (value - center) / scale END', 'z_early')} FROM e0 JOIN c USING (tag)",
)
def _(spark, folder):
    return windows.early_segment_z(shapes.sensor_long(spark, folder)).select("ts", "tag", "value", "z_early")


@query(
    "e6_time_rolling_mean",
    f"WITH {HOURLY} SELECT ts, tag, {rs('value')}, round(avg(value) OVER (PARTITION BY tag ORDER BY ts "
    "RANGE BETWEEN INTERVAL 4 DAYS + INTERVAL 23 HOURS + INTERVAL 59 MINUTES PRECEDING AND CURRENT ROW), 6) + 0.0 AS smooth FROM hourly",
    digits=8,
)
def _(spark, folder):
    return windows.time_rolling_mean(shapes.sensor_hourly(spark, folder)).select("ts", "tag", "value", "smooth")


def _f(back: int, ahead: int) -> str:
    return f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"


def deviation_sql(src: str) -> str:
    """CTE ``feat``: level, spike, change and volatility z."""
    return ", ".join(
        [
            center_scale(src, "value", "lv"),
            f"f0 AS (SELECT s.*, (value - center) / scale AS level_z FROM {src} s JOIN lv USING (tag))",
            f"f1 AS (SELECT *, value - CASE WHEN count(value) {_f(2, 2)} >= 2 THEN quantile_cont(value, 0.5) {_f(2, 2)} END AS resid, "
            f"level_z - lag(level_z) OVER ({W}) AS chg, "
            f"CASE WHEN count(level_z) {_f(3, 3)} >= 3 THEN stddev_samp(level_z) {_f(3, 3)} END AS vol FROM f0)",
            center_scale("f1", "resid", "cr"),
            center_scale("f1", "chg", "cc"),
            center_scale("f1", "vol", "cv"),
            "feat AS (SELECT f1.ts, f1.row_index, f1.tag, f1.value, f1.level_z, coalesce(resid / cr.scale, 0.0) AS spike_z, "
            "coalesce(chg / cc.scale, 0.0) AS change_z, coalesce((vol - cv.center) / cv.scale, 0.0) AS volatility_z "
            "FROM f1 JOIN cr USING (tag) JOIN cc USING (tag) JOIN cv USING (tag))",
        ]
    )


@query(
    "e7_spike_change_volatility_z",
    f"WITH {SENSOR}, {deviation_sql('sensor')} SELECT ts, tag, {rs('value', 'level_z', 'spike_z', 'change_z')} FROM feat",
)
def _(spark, folder):
    """E7 spike and E9 change; E8 is checked beside it with fewer digits."""
    df = windows.deviation_features(shapes.sensor_long(spark, folder))
    return df.select("ts", "tag", "value", "level_z", "spike_z", "change_z")


@query(
    "e8_volatility_z",
    f"WITH {SENSOR}, {deviation_sql('sensor')} SELECT ts, tag, round(volatility_z, 6) + 0.0 AS volatility_z FROM feat",
    digits=4,
)
def _(spark, folder):
    return windows.deviation_features(shapes.sensor_long(spark, folder)).select("ts", "tag", "volatility_z")


@query(
    "e10_flatline",
    f"WITH {SHIP} SELECT ts, tag, {rs('value')}, (count(value) {_f(4, 0)} = 5 AND min(value) {_f(4, 0)} = max(value) {_f(4, 0)}) AS flatline FROM ship",
)
def _(spark, folder):
    return windows.flatline(shapes.ship_daily(spark, folder).lane()).done().select("ts", "tag", "value", "flatline")


@query(
    "e11_jump",
    f"WITH {SENSOR}, d AS (SELECT *, abs(value - lag(value) OVER ({W})) AS ad FROM sensor), "
    "s AS (SELECT tag, stddev_samp(ad) AS sd FROM d GROUP BY tag) "
    f"SELECT ts, d.tag, {rs('value')}, coalesce(ad > 3 * sd, FALSE) AS jump FROM d JOIN s USING (tag)",
)
def _(spark, folder):
    return windows.jump(shapes.sensor_long(spark, folder)).select("ts", "tag", "value", "jump")


_FLAG = "fl AS (SELECT *, value > 75 AS flag FROM sensor)"


def _flagged(spark, folder):
    s = shapes.sensor_long(spark, folder)
    return s, s.lane(s.df.withColumn("flag", F.col("value") > 75))


@query(
    "e12_persist_in_window",
    f"WITH {SENSOR}, {_FLAG}, c AS (SELECT *, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) {_f(1, 1)} AS BIGINT) AS persistent_count FROM fl) "
    "SELECT ts, tag, flag, persistent_count, persistent_count >= 2 AS persistent FROM c",
)
def _(spark, folder):
    _, lane = _flagged(spark, folder)
    df = windows.persist_in_window(lane, "flag", "persistent").done()
    return df.select("ts", "tag", "flag", "persistent_count", "persistent")


@query(
    "e13_neighbour_persist",
    f"WITH {SENSOR}, {_FLAG} SELECT ts, tag, flag, (CAST(flag AS INT) + coalesce(lag(CAST(flag AS INT)) OVER ({W}), 0) "
    f"+ coalesce(lead(CAST(flag AS INT)) OVER ({W}), 0)) >= 2 AS persistent FROM fl",
)
def _(spark, folder):
    _, lane = _flagged(spark, folder)
    return windows.neighbour_persist(lane, "flag", "persistent").done().select("ts", "tag", "flag", "persistent")


_FIRED = "fi AS (SELECT *, CAST(floor(least(value / 40, 5)) AS INT) AS fired FROM sensor)"


@query(
    "e14_isolation_downgrade",
    f"WITH {SENSOR}, {_FIRED}, w AS (SELECT *, sum(CASE WHEN fired >= 2 THEN 1 ELSE 0 END) {_f(2, 2)} AS near, "
    "CASE WHEN fired >= 3 THEN 'Actual Outlier' WHEN fired >= 2 THEN 'Warning' ELSE 'Normal' END AS c FROM fi) "
    "SELECT ts, tag, CAST(fired AS BIGINT) AS fired, CASE WHEN c = 'Actual Outlier' AND near <= 1 AND fired < 4 THEN 'Warning' ELSE c END AS final_class FROM w",
)
def _(spark, folder):
    s = shapes.sensor_long(spark, folder)
    df = s.df.withColumn("fired", F.floor(F.least(F.col("value") / 40, F.lit(5))).cast("int"))
    cls = F.when(F.col("fired") >= 3, "Actual Outlier").when(F.col("fired") >= 2, "Warning").otherwise("Normal")
    lane = windows.isolation_downgrade(s.lane(df.withColumn("final_class", cls)), "fired", "final_class")
    return lane.done().select("ts", "tag", "fired", "final_class")


def runs_sql(src: str, flag: str, out: str, name: str = "run_len") -> str:
    """CTE ``out``: the source with the length of the true run of each row."""
    return (
        f"{out}_a AS (SELECT *, CASE WHEN {flag} IS DISTINCT FROM lag({flag}) OVER ({W}) THEN 1 ELSE 0 END AS st FROM {src}), "
        f"{out}_b AS (SELECT *, sum(st) OVER ({W} ROWS UNBOUNDED PRECEDING) AS gid FROM {out}_a), "
        f"{out} AS (SELECT * EXCLUDE (st, gid), CAST(CASE WHEN {flag} THEN count(*) OVER (PARTITION BY tag, gid) ELSE 0 END AS BIGINT) AS {name} FROM {out}_b)"
    )


@query(
    "e15_run_length",
    f"WITH {SENSOR}, {_FLAG}, {runs_sql('fl', 'flag', 'rl')} SELECT ts, tag, flag, run_len FROM rl",
)
def _(spark, folder):
    _, lane = _flagged(spark, folder)
    return windows.run_length(lane, "flag", "run_len").done().select("ts", "tag", "flag", "run_len")


_BASE30 = f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
_BASE_NAMES = ["ts", "tag", "value", "baseline_mean", "baseline_std", "z_score", "lower_limit", "upper_limit"]
_BASEALL = f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _baseline(frame: str) -> str:
    return (
        f"WITH {SENSOR}, b AS (SELECT ts, tag, value, row_number() OVER ({W}) AS pos, avg(value) {frame} AS m, stddev_pop(value) {frame} AS s FROM sensor) "
        f"SELECT ts, tag, {rs('value')}, {r('m', 'baseline_mean')}, {r('s', 'baseline_std')}, "
        f"{r('CASE WHEN s > 0 THEN (value - m) / s END', 'z_score')}, {r('m - 3 * s', 'lower_limit')}, {r('m + 3 * s', 'upper_limit')} FROM b WHERE pos > 30"
    )


@query("e22_rolling_baseline_rolling", _baseline(_BASE30), digits=8)
def _(spark, folder):
    df = windows.rolling_baseline(shapes.sensor_long(spark, folder), 30)
    return df.select(*_BASE_NAMES)


# Means over 2^k readings end exactly on a rounding tie; both sides lean the same way.
_LEAN = "(1 + 1e-12::DOUBLE)"


@query("e22_rolling_baseline_expanding", _baseline(_BASEALL).replace("round(m,", f"round(m * {_LEAN},").replace("3 * s,", f"3 * s + 50 * ({_LEAN} - 1),"), digits=7)
def _(spark, folder):
    df = windows.rolling_baseline(shapes.sensor_long(spark, folder), 30, expanding=True)
    lean = F.lit(1 + 1e-12)
    df = df.withColumn("baseline_mean", F.col("baseline_mean") * lean)
    df = df.withColumns({c: F.col(c) + 50 * (lean - 1) for c in ("lower_limit", "upper_limit")})
    return df.select(*_BASE_NAMES)


def _ewma_sql(src: str, span: int) -> str:
    """The mean carried from reading to reading by recursion, and shown on the next row."""
    keep = f"(1 - 2.0::DOUBLE / ({span} + 1))"
    return (
        f"o AS (SELECT *, row_number() OVER ({W}) AS pos FROM {src}), s AS (SELECT tag, pos, value, row_number() OVER (PARTITION BY tag ORDER BY pos) AS nr, pos - lag(pos) OVER (PARTITION BY tag ORDER BY pos) AS gap FROM o WHERE value IS NOT NULL), "
        f"w AS (SELECT *, pow({keep}, gap) AS old FROM s), "
        f"e(tag, pos, nr, mean) AS (SELECT tag, pos, nr, value FROM w WHERE nr = 1 UNION ALL SELECT w.tag, w.pos, w.nr, (w.old * e.mean + (1 - {keep}) * w.value) / (w.old + 1 - {keep}) FROM e JOIN w ON w.tag = e.tag AND w.nr = e.nr + 1) "
        f"SELECT ts, o.tag, {rs('value')}, round(last_value(mean IGNORE NULLS) OVER (PARTITION BY o.tag ORDER BY o.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) + 0.0 AS ewma_prev FROM o LEFT JOIN e ON e.tag = o.tag AND e.pos = o.pos"
    )


@query("e23_ewma_prev", f"WITH RECURSIVE {ORDERS}, {_ewma_sql('ords', 12)}")
def _(spark, folder):
    return windows.ewma_prev(shapes.order_daily(spark, folder)).select("ts", "tag", "value", F.round("ewma_prev", 4).alias("ewma_prev"))


# every fifth reading missing
@query(
    "e23_ewma_prev_gappy",
    f"WITH RECURSIVE {ORDERS}, gp AS (SELECT ts, tag, row_index, CASE WHEN day(ts) % 5 <> 0 THEN value END AS value FROM ords), {_ewma_sql('gp', 5)}",
)
def _(spark, folder):
    s = shapes.order_daily(spark, folder).pipe(lambda d: d.withColumn("value", F.when(F.day("ts") % 5 != 0, F.col("value"))))
    return windows.ewma_prev(s, 5).select("ts", "tag", "value", F.round("ewma_prev", 4).alias("ewma_prev"))


@query(
    "e24_lag_features",
    f"WITH {USER} SELECT ts, tag, {rs('value')}, "
    + ", ".join(r(f"lag(value, {k}) OVER ({W})", f"lag{k}") for k in (1, 2, 3))
    + " FROM users",
)
def _(spark, folder):
    return windows.lag_features(shapes.user_long(spark, folder)).select("ts", "tag", "value", "lag1", "lag2", "lag3")


def _roll(fn: str, n: int) -> str:
    f = f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(value) {f} >= {max(3, n // 3)} THEN {fn}(value) {f} END"


@query(
    "e25_rolling_features",
    f"WITH {SENSOR} SELECT ts, tag, {rs('value')}, "
    + ", ".join(r(_roll(fn, n), f"{nm}_{n}") for n in (9, 31) for nm, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + f", {r(f'value - lag(value) OVER ({W})', 'diff')}, {r(f'abs(value - lag(value) OVER ({W}))', 'abs_diff')}, "
    + r("value - " + _roll("avg", 31), "resid_31")
    + f", hour(ts) AS hour, isodow(ts) - 1 AS weekday, row_number() OVER ({W}) <= greatest(10, floor(count(*) OVER (PARTITION BY tag) * 0.28)) AS early FROM sensor",
)
def _(spark, folder):
    return windows.rolling_features(shapes.sensor_long(spark, folder)).drop("row_index")


@query(
    "e26_time_split",
    f"WITH {ORDERS} SELECT ts, tag, {rs('value')}, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY tag) * 0.7) AS historic FROM ords",
)
def _(spark, folder):
    return windows.time_split(shapes.order_daily(spark, folder)).select("ts", "tag", "value", "historic")


@query(
    "e27_spike_relabel",
    f"WITH {SENSOR}, k AS (SELECT *, CASE WHEN value > 150 THEN 'Strong Anomaly' WHEN value > 90 THEN 'Drift' ELSE 'Normal' END AS cls, value > 90 AS flag FROM sensor), "
    f"{runs_sql('k', 'flag', 'rl')} SELECT ts, tag, {rs('value')}, CASE WHEN run_len BETWEEN 1 AND 2 THEN 'Spike - Returned Normal' ELSE cls END AS final_class FROM rl",
)
def _(spark, folder):
    s = shapes.sensor_long(spark, folder)
    cls = F.when(F.col("value") > 150, "Strong Anomaly").when(F.col("value") > 90, "Drift").otherwise("Normal")
    return windows.spike_relabel(s, s.df.withColumn("final_class", cls)).select("ts", "tag", "value", "final_class")


@query(
    "e28_rank_tags",
    f"WITH {USER}, s AS (SELECT tag, count(*) AS score FROM users GROUP BY tag) "
    "SELECT tag, score, row_number() OVER (ORDER BY score DESC, tag) AS rank_order FROM s",
)
def _(spark, folder):
    s = shapes.user_long(spark, folder)
    return windows.rank_tags(s.df.groupBy("tag").agg(F.count(F.lit(1)).alias("score")), "score").select("tag", "score", "rank_order")


@query(
    "e32_every_kth",
    f"WITH {SENSOR}, p AS (SELECT *, row_number() OVER ({W}) AS pos, count(*) OVER (PARTITION BY tag) AS cnt FROM sensor) "
    f"SELECT ts, tag, {rs('value')} FROM p WHERE (pos - 1) % greatest(cnt // 400, 1) = 0",
)
def _(spark, folder):
    return windows.every_kth(shapes.sensor_long(spark, folder), 400).select("ts", "tag", "value")
