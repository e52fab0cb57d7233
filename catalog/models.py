"""Learned models of every tag, with the sizes that the operators default to; importances and winners have no SQL."""

from pyspark.sql import functions as F

from catalog.base import SHIP, query, rs
from catalog.pairs import _corr
from sensorium.operators import consensus, models
from sensorium.sources import shapes

# correlation, mutual information and lagged correlation of every directed pair
_SCORES = (
    f"p AS ({_corr('ship')}), r2 AS (SELECT tag_a AS target, tag_b AS peer, r FROM p UNION ALL SELECT tag_b, tag_a, r FROM p), "
    "e AS (SELECT tag, min(value) AS lo, max(value) AS hi FROM ship GROUP BY tag), bn AS (SELECT ts, ship.tag, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 14), 13) ELSE 0 END AS k FROM ship JOIN e USING (tag)), "
    "c AS (SELECT a.tag AS target, b.tag AS peer, a.k AS ka, b.k AS kb, count(*) AS n FROM bn a JOIN bn b ON a.ts = b.ts AND a.tag <> b.tag GROUP BY ALL), "
    "t AS (SELECT *, sum(n) OVER (PARTITION BY target, peer) AS nt, sum(n) OVER (PARTITION BY target, peer, ka) AS na, sum(n) OVER (PARTITION BY target, peer, kb) AS nb FROM c), "
    "mi AS (SELECT target, peer, greatest(sum(n / nt * ln(n * nt / (na * nb))), 0.0) AS mi FROM t GROUP BY 1, 2), "
    "g AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM ship)), v AS (SELECT ship.tag, pos, value FROM ship JOIN g USING (ts)), "
    "lc AS (SELECT a.tag AS target, b.tag AS peer, a.pos - b.pos AS lag, corr(a.value, b.value) AS r, count(*) AS n FROM v a JOIN v b ON b.pos BETWEEN a.pos - 5 AND a.pos - 1 AND a.tag <> b.tag GROUP BY 1, 2, 3), "
    "lb AS (SELECT target, peer, r AS lag_r FROM lc WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY target, peer ORDER BY round(abs(r), 12) DESC, lag) = 1), "
    "sc AS (SELECT target, peer, r2.r, mi, lag_r FROM r2 JOIN mi USING (target, peer) JOIN lb USING (target, peer)), "
    "rk AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY target ORDER BY round(abs({c}), 10) DESC, peer) AS p_{c}" for c in ("r", "mi", "lag_r")) + " FROM sc)"
)


@query("k1_pair_scores", f"WITH {SHIP}, {_SCORES} SELECT target, peer, {rs('r', 'mi', 'lag_r')} FROM sc")
def _(spark, folder):
    return models.pair_scores(shapes.ship_daily(spark, folder).stored())


@query("g2_candidate_union", f"WITH {SHIP}, {_SCORES} SELECT target, peer FROM rk WHERE p_r <= 10 OR p_mi <= 10 OR p_lag_r <= 10")
def _(spark, folder):
    return models.candidate_peers(shapes.ship_daily(spark, folder).stored())


@query("g2_candidate_union_narrow", f"WITH {SHIP}, {_SCORES} SELECT target, peer FROM rk WHERE p_r <= 3 OR p_mi <= 3 OR p_lag_r <= 3")
def _(spark, folder):
    return models.candidate_peers(shapes.ship_daily(spark, folder).stored(), 3)


@query("k1_dynamic_peers")
def _(spark, folder):
    return models.dynamic_peers(shapes.ship_daily(spark, folder).stored())


@query("k2_tree_importance")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder).stored()
    return models.tree_importance(s, models.candidates_of(models.pair_scores(s)))


@query("k3_train_winner")
def _(spark, folder):
    """The winning model of every tag and the residuals it leaves."""
    s = shapes.ship_daily(spark, folder).stored()
    peers = models.dynamic_peers(s, 10, 0.15)
    winners = models.train_winners(s, peers)
    return models.peer_signal(s, peers, winners).join(winners.select("target", "model_name", "model_type", "cv_rmse", "cv_r2").withColumnRenamed("target", "tag"), "tag")


@query("k4_model_attribution")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder).stored()
    return models.model_attribution(s, models.candidates_of(models.pair_scores(s)))


# |rho| of all pairs, then each target's other tags by name, one by one; a tag like one already held is passed over.
_FEATURES = (
    f"rr AS (SELECT ts, tag, rank() OVER (PARTITION BY tag ORDER BY value) + (count(*) OVER (PARTITION BY tag, value) - 1) / 2.0 AS value FROM ship), "
    "rh0 AS (SELECT a.tag AS target, b.tag, abs(corr(a.value, b.value)) AS rho FROM rr a JOIN rr b ON a.ts = b.ts AND a.tag <> b.tag GROUP BY 1, 2), "
    "li AS (SELECT target, tag, row_number() OVER (PARTITION BY target ORDER BY tag) AS nr FROM rh0), "
    "tw AS (SELECT l.target, l.tag, l.nr, coalesce(list(o.tag) FILTER (o.tag IS NOT NULL), []) AS near FROM li l LEFT JOIN rh0 o ON o.target = l.tag AND o.rho >= SIMILAR GROUP BY ALL), "
    "gr(target, nr, held) AS (SELECT DISTINCT target, 0::BIGINT, []::VARCHAR[] FROM li UNION ALL SELECT gr.target, tw.nr, CASE WHEN list_has_any(tw.near, held) THEN held ELSE list_append(held, tw.tag) END FROM gr JOIN tw ON tw.target = gr.target AND tw.nr = gr.nr + 1), "
    "kp AS (SELECT target, unnest(held) AS tag FROM gr QUALIFY nr = max(nr) OVER (PARTITION BY target)), "
    "nn AS (SELECT tag, count(value) AS n FROM ship GROUP BY tag), "
    "ft AS (SELECT kp.target, kp.tag, rho, mi, sc.r, CASE WHEN abs(sc.r) < 1 THEN sc.r * sc.r / (1 - sc.r * sc.r) * (nn.n - 2) ELSE 0.0 END AS f FROM kp JOIN rh0 USING (target, tag) JOIN sc ON sc.target = kp.target AND sc.peer = kp.tag JOIN nn ON nn.tag = kp.tag), "
    "fs AS (SELECT *, rho + mi + f AS score FROM ft)"
)
_FEATURE_SQL = f"WITH RECURSIVE {SHIP}, {_SCORES}, {_FEATURES} SELECT target, tag, {rs('rho', 'mi', 'r')}, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, tag) AS rank, round(f, 3) + 0.0 AS f, round(score, 3) + 0.0 AS score FROM fs"


for _name, _similar in (("k5_feature_filter", 0.92), ("k5_feature_filter_strict", 0.3)):

    @query(_name, _FEATURE_SQL.replace("SIMILAR", str(_similar)))
    def _(spark, folder, similar=_similar):
        """Features of every tag; the strict one passes over many like ones."""
        df = models.feature_filter(shapes.ship_daily(spark, folder).stored(), similar=similar)
        return df.withColumns({"f": F.round("f", 3), "score": F.round("score", 3)})


@query("i20_detect_multimodel")
def _(spark, folder):
    """The eight-signal vote with every tag's winning model as its peer signal."""
    df, _ = consensus.multimodel(shapes.ship_daily(spark, folder).stored())
    return df.select("ts", "tag", "value", "predicted", "z_peer", "fire_s5_peer", "signals_fired", "final_class")
