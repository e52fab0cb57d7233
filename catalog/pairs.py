"""Pair statistics, peers and linear models."""

from pyspark.sql import functions as F

from catalog import sqlparts as sp
from catalog.base import HOURLY, ORDERS, SHIP, query, r, rs
from sensorium.operators import pairs, regress
from sensorium.sources import shapes


def _corr(src: str) -> str:
    return (
        f"SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n, CASE WHEN count(*) < 3 OR stddev_samp(a.value) < 1e-12 OR stddev_samp(b.value) < 1e-12 THEN 0.0 "
        f"ELSE corr(a.value, b.value) END AS r FROM {src} a JOIN {src} b ON a.ts = b.ts AND a.tag < b.tag WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2"
    )


@query("d39_pearson", f"WITH {SHIP}, p AS ({_corr('ship')}) SELECT tag_a, tag_b, n, {rs('r')} FROM p")
def _(spark, folder):
    return pairs.pearson(shapes.ship_daily(spark, folder))


@query("d39_pearson_gappy", f"WITH {ORDERS}, p AS ({_corr('ords')}) SELECT tag_a, tag_b, n, {rs('r')} FROM p")
def _(spark, folder):
    return pairs.pearson(shapes.order_daily(spark, folder))


@query("d49_f_regression", f"WITH {SHIP}, p AS ({_corr('ship')}) SELECT tag_a, tag_b, n, {rs('r')}, round(r * r / (1 - r * r) * (n - 2), 3) + 0.0 AS f FROM p")
def _(spark, folder):
    return pairs.f_regression(shapes.ship_daily(spark, folder)).withColumn("f", F.round("f", 3))


@query(
    "d40_spearman",
    f"WITH {SHIP}, rk AS (SELECT ts, tag, rank() OVER (PARTITION BY tag ORDER BY value) + (count(*) OVER (PARTITION BY tag, value) - 1) / 2.0 AS value FROM ship), "
    f"p AS ({_corr('rk')}) SELECT tag_a, tag_b, n, {r('r', 'rho')} FROM p",
)
def _(spark, folder):
    return pairs.spearman(shapes.ship_daily(spark, folder))


_GRID = (
    f"{ORDERS}, g AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM ords)), v AS (SELECT ords.tag, pos, value FROM ords JOIN g USING (ts))"
)


@query(
    "d41_lag_corr",
    f"WITH {_GRID}, c AS (SELECT a.tag AS target, b.tag AS source, a.pos - b.pos AS lag, count(*) AS n, corr(a.value, b.value) AS r FROM v a JOIN v b ON b.pos BETWEEN a.pos - 5 AND a.pos - 1 AND a.tag <> b.tag GROUP BY 1, 2, 3) "
    f"SELECT target, source, lag AS best_lag, {r('r', 'lag_r')} FROM c WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY target, source ORDER BY round(abs(r), 12) DESC, lag) = 1",
)
def _(spark, folder):
    return pairs.lag_corr(shapes.order_daily(spark, folder), 5)


@query(
    "d42_cross_corr",
    f"WITH {_GRID}, c AS (SELECT a.tag AS target, b.tag AS source, a.pos - b.pos AS lag, count(*) AS n, corr(a.value, b.value) AS r FROM v a JOIN v b ON b.pos BETWEEN a.pos - 7 AND a.pos + 7 AND a.tag <> b.tag GROUP BY 1, 2, 3), "
    "z AS (SELECT target, source, r FROM c WHERE lag = 0) "
    f"SELECT c.target, c.source, {r('c.r', 'best_r')}, c.lag AS best_lag, {r('z.r', 'zero_lag_r')} FROM c LEFT JOIN z USING (target, source) WHERE n >= 30 "
    "QUALIFY row_number() OVER (PARTITION BY c.target, c.source ORDER BY round(abs(c.r), 12) DESC, c.lag) = 1",
)
def _(spark, folder):
    return pairs.cross_corr(shapes.order_daily(spark, folder), 7)


@query(
    "d43_hist_mutual_info",
    f"WITH {SHIP}, e AS (SELECT tag, min(value) AS lo, max(value) AS hi FROM ship GROUP BY tag), k AS (SELECT ts, ship.tag, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 14), 13) ELSE 0 END AS k FROM ship JOIN e USING (tag)), "
    "c AS (SELECT a.tag AS tag_a, b.tag AS tag_b, a.k AS ka, b.k AS kb, count(*) AS n FROM k a JOIN k b ON a.ts = b.ts AND a.tag < b.tag GROUP BY ALL), "
    "t AS (SELECT *, sum(n) OVER (PARTITION BY tag_a, tag_b) AS nt, sum(n) OVER (PARTITION BY tag_a, tag_b, ka) AS na, sum(n) OVER (PARTITION BY tag_a, tag_b, kb) AS nb FROM c), "
    "m AS (SELECT tag_a, tag_b, greatest(sum(n / nt * ln(n * nt / (na * nb))), 0.0) AS mi FROM t GROUP BY 1, 2) "
    f"SELECT tag_a, tag_b, {rs('mi')}, {r('least(1.0, mi / (SELECT quantile_cont(mi, 0.95) FROM m))', 'mi_norm')} FROM m",
)
def _(spark, folder):
    return pairs.hist_mutual_info(shapes.ship_daily(spark, folder))


@query("d45_granger")
def _(spark, folder):
    s = shapes.order_daily(spark, folder)
    both = pairs.both_ways(pairs.pearson(s)).select(F.col("tag_a").alias("target"), F.col("tag_b").alias("source"))
    return pairs.granger(s, both)


@query("j5_tag_relationships")
def _(spark, folder):
    return pairs.tag_relationships(shapes.order_daily(spark, folder), 5)


_PEERS = (
    f"p AS ({_corr('ship')}), d AS (SELECT tag_a AS target, tag_b AS peer, r FROM p UNION ALL SELECT tag_b, tag_a, r FROM p), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(r), 10) DESC, peer) AS rank, max(round(abs(r), 10)) OVER (PARTITION BY target) AS best FROM d), "
    "pe AS (SELECT target, peer, rank, r FROM k WHERE rank <= 5 AND (round(abs(r), 10) >= 0.35 OR best < 0.35))"
)


@query("k1_select_peers", f"WITH {SHIP}, {_PEERS} SELECT target, peer, rank, {rs('r')} FROM pe")
def _(spark, folder):
    return regress.peers_by_corr(shapes.ship_daily(spark, folder))


_R2 = "1 - sum((y - (w0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4 + w5 * x5)) ** 2) / sum((y - my) ** 2)"


def _fit_sql(src: str, least: float, alpha: float, intercept: float, rows: int, centred: bool) -> str:
    """Weights (those of missing peers 0), rows and R² of every target."""
    filled = ", ".join(f"CASE WHEN k < {j} THEN 0.0 ELSE x{j} END AS x{j}" for j in range(1, 6))
    return (
        f"{sp.peers_by_corr(_corr(src), least)}, {sp.design(src, 'pe', 5)}, dw AS (SELECT * FROM dz WHERE {sp.whole(5)}), {sp.solved('dw', 5, alpha, intercept, 'wt', centred)}, "
        f"q AS (SELECT target, y, avg(y) OVER (PARTITION BY target) AS my, {filled} FROM dw) "
        f"SELECT target, list_value({', '.join(f'round(w{j}, 4) + 0.0' for j in range(6))}) AS w, any_value(train_rows) AS train_rows, round({_R2}, 6) + 0.0 AS r2 FROM q JOIN wt USING (target) GROUP BY target, w0, w1, w2, w3, w4, w5 HAVING any_value(train_rows) >= {rows}"
    )


def _rounded(df):
    return df.withColumn("w", F.transform("w", lambda v: F.round(v, 4) + F.lit(0.0)))


@query("d46_ridge_fit", f"WITH {SHIP}, {_fit_sql('ship', 0.35, 1.0, 1.0, 10, False)}")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    peers = regress.peers_by_corr(s)
    return _rounded(regress.fit(regress.design_rows(s, peers, 5), peers, 5, 1.0, True, False))


@query("d47_ols_fit", f"WITH {HOURLY}, {_fit_sql('hourly', 0.0, 0.0, 0.0, 24, True)}")
def _(spark, folder):
    s = shapes.sensor_hourly(spark, folder)
    peers = regress.peers_by_corr(s, 5, None)
    return _rounded(regress.fit(regress.design_rows(s, peers, 5), peers, 5, 0.0, False, False, 24))
