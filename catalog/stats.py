"""Robust statistics per tag."""

from pyspark.sql import functions as F

from catalog.base import SENSOR, SHIP, USER, center_scale, query, r, rs
from sensorium.functions.classes import z_ladder
from sensorium.functions.scalar import count_of
from sensorium.operators import stats
from sensorium.sources import shapes

for _policy in ("floor", "std1", "std0", "ladder", "zero"):

    @query(
        f"d2_robust_scale_{_policy}",
        f"WITH {SHIP}, {center_scale('ship', 'value', 'c', _policy, '1e-12' if _policy == 'ladder' else '1e-9')} "
        f"SELECT tag, n, {rs('center', 'scale')} FROM c",
    )
    def _(spark, folder, policy=_policy):
        return stats.robust_scale(shapes.ship_daily(spark, folder), policy, 1e-12 if policy == "ladder" else 1e-9)


@query(
    "d2_robust_scale_nan_poison",
    f"WITH {SHIP}, base AS (SELECT ts, tag, CASE WHEN tag = 'qty_A_F' AND value = 0 THEN NULL ELSE value END AS value FROM ship), "
    "m AS (SELECT tag, count(value) AS n, count(*) - count(value) AS holes, median(value) AS center, mad(value) AS mad, stddev_samp(value) AS std FROM base GROUP BY tag) "
    f"SELECT tag, n, {r('center')}, {r('CASE WHEN holes = 0 THEN CASE WHEN mad = 0 THEN CASE WHEN std > 0 THEN std ELSE 1.0 END ELSE 1.4826 * mad END END', 'scale')} FROM m",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    hole = (F.col("tag") == "qty_A_F") & (F.col("value") == 0)
    return stats.robust_scale(s.pipe(lambda d: d.withColumn("value", F.when(~hole, F.col("value")))), "nan_poison")


@query(
    "d53_robust_z",
    f"WITH {USER}, {center_scale('users', 'value', 'c')} "
    f"SELECT ts, u.tag, {rs('value', 'center', 'scale')}, {r('(value - center) / scale', 'z')} FROM users u JOIN c USING (tag)",
)
def _(spark, folder):
    return stats.robust_z(shapes.user_long(spark, folder)).select("ts", "tag", "value", "center", "scale", "z")


@query(
    "d3_inner_trim",
    f"WITH {SENSOR}, b AS (SELECT tag, quantile_cont(value, 0.15) AS lo, quantile_cont(value, 0.85) AS hi FROM sensor GROUP BY tag) "
    f"SELECT s.tag, count(*) AS n, {r('avg(value)', 'mean')}, {r('min(value)', 'low')}, {r('max(value)', 'high')} "
    "FROM sensor s JOIN b USING (tag) WHERE value BETWEEN lo AND hi GROUP BY s.tag",
)
def _(spark, folder):
    s = shapes.sensor_long(spark, folder)
    kept = stats.inner_trim(s, 0.15, 25)
    return kept.groupBy("tag").agg(
        F.count("inner").alias("n"),
        F.avg("inner").alias("mean"),
        F.min("inner").alias("low"),
        F.max("inner").alias("high"),
    )


_PROFILE = (
    f"WITH {SHIP}, {center_scale('ship', 'value', 'c', 'POLICY')}, q AS (SELECT tag, min(value) AS lo, max(value) AS hi, "
    + ", ".join(f"quantile_cont(value, 0.{p}) AS p{p}" for p in ("01", "05", "25", "75", "95", "99"))
    + " FROM ship GROUP BY tag), j AS (SELECT c.*, q.*, CASE WHEN STD >= 1e-9 THEN STD ELSE scale END AS s FROM c JOIN q USING (tag)) "
    f"SELECT tag, n, {rs('mean')}, {r('s', 'std')}, {r('center', 'median')}, {r('scale', 'mad_scale')}, {r('lo', 'min')}, {r('hi', 'max')}, "
    f"{rs('p01', 'p05', 'p95', 'p99')}, {r('greatest(EFFECT, 1e-9)', 'effective_scale')} FROM j"
)

for _rule, _pol, _std, _eff in (
    ("none", "std1", "std", "s"),
    ("min", "std1", "std", "least(s, 1.35 * scale)"),
    ("clamp", "std0", "std0", "greatest(least(s, 1.35 * greatest(scale, (p75 - p25) / 1.349)), 0.75 * scale)"),
):

    @query(f"d14_reference_profile_{_rule}", _PROFILE.replace("POLICY", _pol).replace("STD", _std).replace("EFFECT", _eff))
    def _(spark, folder, rule=_rule):
        s = shapes.ship_daily(spark, folder)
        return stats.reference_profile(s, s.df, rule)


_LADDER = (
    f"WITH {SENSOR}, {center_scale('sensor', 'value', 'c')}, "
    "z AS (SELECT s.*, abs((value - center) / scale) AS az FROM sensor s JOIN c USING (tag)), "
    "k AS (SELECT *, CASE WHEN az >= 5 THEN 'Strong Anomaly' WHEN az >= 3.5 THEN 'Drift + Anomaly' WHEN az >= 3 THEN 'Drift' ELSE 'Normal' END AS cls FROM z) "
    "SELECT tag, count(*) AS total_rows, count(*) FILTER (cls <> 'Normal') AS abnormal_count, count(*) FILTER (cls = 'Strong Anomaly') AS strong_count, "
    f"{r('max(az)', 'max_abs_z')} FROM k GROUP BY tag ORDER BY abnormal_count DESC, tag LIMIT 10"
)


@query("f1_top_k_tags", _LADDER)
def _(spark, folder):
    """Flagship: robust z ladder, tag summary, ten worst tags."""
    z = stats.robust_z(shapes.sensor_long(spark, folder)).withColumn("az", F.abs("z"))
    scored = z.withColumn("cls", z_ladder(F.col("az"), F.lit(3.0), F.lit(3.5), F.lit(5.0)))
    return (
        scored.groupBy("tag")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            count_of(F.col("cls") != "Normal").alias("abnormal_count"),
            count_of(F.col("cls") == "Strong Anomaly").alias("strong_count"),
            F.max("az").alias("max_abs_z"),
        )
        .orderBy(F.desc("abnormal_count"), "tag")
        .limit(10)
    )
