"""Cluster clean periods, clusters and cluster detectors."""

from pyspark.sql import functions as F

from catalog.base import SHIP, W, center_scale, query, rs
from catalog.pairs import _corr
from sensorium.operators import clusters, pairs
from sensorium.operators.stats import reference_profile
from sensorium.sources import shapes

_Z = f"{SHIP}, {center_scale('ship', 'value', 'c')}, z AS (SELECT ts, ship.tag, row_index, (value - center) / scale AS z FROM ship JOIN c USING (tag)), tn AS (SELECT count(DISTINCT tag) AS tn FROM ship)"


def _scores(limit: str, weight: str) -> str:
    return (
        f"q AS (SELECT ts, count_if(abs(z) > {limit}) / max(tn) AS bad_fraction, quantile_cont(abs(z), 0.5) AS median_abs_z, quantile_cont(abs(z), 0.9) AS p90_abs_z FROM z, tn GROUP BY ts), "
        f"sc AS (SELECT *, median_abs_z + 0.6 * p90_abs_z + {weight} * bad_fraction AS score, row_number() OVER (ORDER BY ts) AS pos FROM q)"
    )


_COLS = rs("bad_fraction", "median_abs_z", "p90_abs_z", "score")


@query("d51_row_quantiles", f"WITH {_Z}, {_scores('3.0', '5.0')} SELECT ts, {_COLS} FROM sc")
def _(spark, folder):
    return clusters.row_quantile_scores(shapes.ship_daily(spark, folder), 3.0, 5.0)[0].drop("pos")


@query(
    "e20_contiguous_candidates",
    f"WITH {_Z}, {_scores('2.8', '2.5')}, k AS (SELECT *, bad_fraction <= 0.12 AND score <= (SELECT quantile_cont(score, 0.45) FROM sc) AS candidate FROM sc), "
    "g AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gid FROM (SELECT *, candidate IS DISTINCT FROM lag(candidate) OVER (ORDER BY pos) AS st FROM k)), "
    "lr AS (SELECT min(pos) AS a, max(pos) AS z, avg(score) + 3 * avg(bad_fraction) - 0.002 * count(*) AS rk FROM g WHERE candidate GROUP BY gid HAVING count(*) >= 360 ORDER BY rk LIMIT 1), "
    "wm AS (SELECT pos, avg(score) OVER f AS ms, avg(bad_fraction) OVER f AS mb FROM sc WINDOW f AS (ORDER BY pos ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)), "
    "fb AS (SELECT pos - 359 AS a, pos AS z FROM wm WHERE pos >= 360 ORDER BY mb > 0.16, round(ms + 5 * mb, 9), pos LIMIT 1), "
    f"b AS (SELECT a, z FROM lr UNION ALL SELECT a, z FROM fb WHERE NOT EXISTS (FROM lr)) SELECT ts, {_COLS}, candidate, pos BETWEEN a AND z AS clean FROM k, b",
)
def _(spark, folder):
    return clusters.contiguous_candidates(shapes.ship_daily(spark, folder))


@query(
    "e19_stepped_windows",
    f"WITH {_Z}, {_scores('3.0', '5.0')}, p AS (SELECT z.tag, sc.pos, z FROM z JOIN sc USING (ts)), "
    "win AS (SELECT w, pos - w + 1 AS a, pos AS e FROM sc, (VALUES (120), (180), (240)) v(w) WHERE pos >= w AND (pos - w) % 7 = 0), "
    "tg AS (SELECT w, e, tag, CASE WHEN stddev_pop(z) < 1e-9 THEN 0 ELSE abs(corr(pos, z)) END AS tr, stddev_samp(z) AS sd FROM win JOIN p ON p.pos BETWEEN a AND e GROUP BY ALL), "
    "tm AS (SELECT w, e, median(tr) AS trend, median(sd) AS spread FROM tg GROUP BY ALL), "
    "rm AS (SELECT w, e, avg(score) AS ms, avg(bad_fraction) AS mb FROM win JOIN sc ON sc.pos BETWEEN a AND e GROUP BY ALL), "
    "bs AS (SELECT w, e FROM tm JOIN rm USING (w, e) ORDER BY round(ms + 2 * spread + 1.5 * trend + 3 * mb, 9), round(mb, 9), round(spread, 9), w, e LIMIT 1) "
    f"SELECT ts, {_COLS}, pos BETWEEN e - w + 1 AND e AS clean FROM sc, bs",
)
def _(spark, folder):
    return clusters.stepped_windows(shapes.ship_daily(spark, folder))


_ZD = (
    f"{SHIP}, {center_scale('ship', 'value', 'c')}, d AS (SELECT *, value - lag(value) OVER ({W}) AS delta FROM ship), {center_scale('d', 'delta', 'cd')}, "
    "z AS (SELECT ts, d.tag, value, (value - c.center) / c.scale AS z, (delta - cd.center) / cd.scale AS dz FROM d JOIN c USING (tag) JOIN cd USING (tag)), tn AS (SELECT count(DISTINCT tag) AS tn FROM ship)"
)


@query(
    "e18_best_window_multi",
    f"WITH {_ZD}, q AS (SELECT ts, count(*) FILTER (abs(z) > 3.5) / max(tn) AS level, count(*) FILTER (abs(dz) > 4) / max(tn) AS spike, median(abs(z)) AS mid FROM z, tn GROUP BY ts), "
    "sc AS (SELECT *, level + 0.5 * spike + 0.02 * coalesce(mid, 0) AS score, row_number() OVER (ORDER BY ts) AS pos FROM q), "
    "m AS (SELECT pos, avg(score) OVER (ORDER BY pos ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS ms FROM sc), b AS (SELECT pos AS e FROM m WHERE pos >= 180 ORDER BY round(ms, 9), pos LIMIT 1) "
    f"SELECT ts, {rs('level', 'spike', 'score')}, pos BETWEEN e - 179 AND e AS clean FROM sc, b",
)
def _(spark, folder):
    return clusters.consistency_window(shapes.ship_daily(spark, folder))


@query(
    "e19_relation_window",
    f"WITH {_ZD}, q AS (SELECT ts, count(*) FILTER (abs(z) > 3.2) / max(tn) AS bad, count(*) FILTER (abs(z) > 4.2) / max(tn) AS ext, count(*) FILTER (abs(dz) > 3.2) / max(tn) AS spike, count(value) / max(tn) AS pr FROM z, tn GROUP BY ts), "
    "sc AS (SELECT *, 0.55 * bad + 0.20 * ext + 0.20 * spike + 0.05 * (1 - pr) AS score, row_number() OVER (ORDER BY ts) AS pos FROM q), "
    "win AS (SELECT w, pos AS a FROM sc, (VALUES (112), (150), (202)) v(w) WHERE (pos - 1) % 10 = 0 AND pos + w - 1 <= (SELECT count(*) FROM sc)), "
    "j AS (SELECT w, a, avg(score) AS s, quantile_cont(score, 0.9) AS p, avg(bad) AS b, avg(spike) AS d FROM win JOIN sc ON pos BETWEEN a AND a + w - 1 GROUP BY ALL), "
    "bs AS (SELECT w, a FROM j ORDER BY round(s + 0.20 * p + 0.10 * b + 0.05 * d - 0.00005 * w, 9), round(b, 9), round(d, 9), w, a LIMIT 1) "
    f"SELECT ts, {rs('score')}, pos BETWEEN a AND a + w - 1 AS clean FROM sc, bs",
)
def _(spark, folder):
    return clusters.relation_window(shapes.ship_daily(spark, folder))


_CLUSTER = (
    f"p AS ({_corr('ship')}), e AS (SELECT tag_a AS a, tag_b AS b FROM p WHERE abs(r) >= 0.58 UNION ALL SELECT tag_b, tag_a FROM p WHERE abs(r) >= 0.58), tg AS (SELECT DISTINCT tag FROM ship), "
    "rc AS (SELECT tag AS src, tag AS dst FROM tg UNION SELECT rc.src, e.b FROM rc JOIN e ON rc.dst = e.a), lb AS (SELECT src AS tag, min(dst) AS label FROM rc GROUP BY src), "
    "sz AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS num FROM lb GROUP BY label HAVING count(*) >= 3), big AS (SELECT num, tag FROM lb JOIN sz USING (label)), "
    "ln AS (SELECT row_number() OVER (ORDER BY tag) + (SELECT count(*) FROM sz) AS num, tag FROM tg WHERE tag NOT IN (SELECT tag FROM big)), "
    "w AS (SELECT tag_a AS a, tag_b AS b, r FROM p UNION ALL SELECT tag_b, tag_a, r FROM p), t6 AS (SELECT a, b FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(abs(r), 10) DESC, b) <= 6), "
    "mb AS (SELECT * FROM big UNION SELECT * FROM ln UNION SELECT num, b FROM ln JOIN t6 ON a = tag)"
)


@query(
    "j7_corr_clusters",
    f"WITH RECURSIVE {SHIP}, {_CLUSTER} SELECT printf('Cluster_%02d', num) AS cluster_id, tag, num = min(num) OVER (PARTITION BY tag) AS is_primary FROM mb",
)
def _(spark, folder):
    return clusters.corr_clusters(shapes.ship_daily(spark, folder))[0]


@query("j8_relation_communities")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return clusters.relation_communities(s.df.select("tag").distinct(), pairs.tag_relationships(s, 3))


@query(
    "j9_strong_groups",
    f"WITH RECURSIVE {SHIP}, p AS ({_corr('ship')}), e AS (SELECT tag_a AS a, tag_b AS b FROM p WHERE abs(r) >= 0.70 UNION ALL SELECT tag_b, tag_a FROM p WHERE abs(r) >= 0.70), "
    "rc AS (SELECT DISTINCT tag AS src, tag AS dst FROM ship UNION SELECT rc.src, e.b FROM rc JOIN e ON rc.dst = e.a), lb AS (SELECT src AS tag, min(dst) AS label FROM rc GROUP BY src) "
    "SELECT tag, dense_rank() OVER (ORDER BY label) AS group_id FROM lb",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    return clusters.strong_groups(s.df.select("tag").distinct(), pairs.pearson(s))


@query("d48_pc1_fit")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    ref = reference_profile(s, s.df).select("tag", "mean", F.col("effective_scale").alias("k"))
    z = s.like(s.attach(ref).select("ts", "tag", "row_index", ((F.col("value") - F.col("mean")) / F.col("k")).alias("value")))
    return clusters.pc1_fit(z, clusters.corr_clusters(s)[0])


@query("i13_cluster_zscore")
def _(spark, folder):
    df = clusters.cluster_zscore(shapes.ship_daily(spark, folder))
    return df.select("ts", "tag", "value", "z", "residual_z", "peer_high", "same_support", "opposite", "final_class", "final_status", "severity")


@query("i14_cluster_pca")
def _(spark, folder):
    return clusters.cluster_pca(shapes.ship_daily(spark, folder))


@query("i15_cluster_consistency")
def _(spark, folder):
    return clusters.cluster_consistency(shapes.ship_daily(spark, folder))


@query("i16_relationship")
def _(spark, folder):
    df = clusters.relationship(shapes.ship_daily(spark, folder))
    return df.select("ts", "tag", "value", "z", "cluster_id", "mismatch_z", "residual_z", "support", "final_class", "severity")
