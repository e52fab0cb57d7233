"""Drift, causal graph and root causes."""

from pyspark.sql import functions as F

from catalog.base import PATHS, SHIP, W, query, rs
from sensorium.functions.scalar import drift_lead_score
from sensorium.operators import causal, drift, models
from sensorium.session import settle
from sensorium.sources import shapes

DRIFT = (
    f"t AS (SELECT *, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY tag) * 0.7) AS h FROM ship), "
    "g AS (SELECT tag, count_if(h) AS n_ref, count_if(NOT h) AS n_cur, avg(value) FILTER (h) AS mr, stddev_samp(value) FILTER (h) AS sr, avg(value) FILTER (NOT h) AS mc, stddev_samp(value) FILTER (NOT h) AS sc FROM t GROUP BY tag), "
    "v AS (SELECT tag, value, count_if(h) AS r, count_if(NOT h) AS c FROM t GROUP BY tag, value), "
    "k AS (SELECT tag, sum(r) OVER (PARTITION BY tag ORDER BY value) AS cr, sum(c) OVER (PARTITION BY tag ORDER BY value) AS cc FROM v), "
    "d AS (SELECT tag, max(abs(cr / n_ref - cc / n_cur)) AS ks FROM k JOIN g USING (tag) GROUP BY tag), "
    "f AS (SELECT tag, min(ts) AS first_drift_ts FROM t JOIN g USING (tag) WHERE NOT h AND (value > mr + 3 * sr OR value < mr - 3 * sr) GROUP BY tag), "
    "x AS (SELECT g.*, ks, first_drift_ts, sqrt(n_ref * n_cur / (n_ref + n_cur)) * ks AS lam, abs(mc - mr) / (abs(mr) + 1e-6) AS ms, abs(sc - sr) / (abs(sr) + 1e-6) AS ss FROM g JOIN d USING (tag) LEFT JOIN f USING (tag)), "
    "y AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0::DOUBLE * k * k * lam * lam))))) END AS p FROM x), "
    "dm AS (SELECT tag, n_ref, n_cur, ks AS ks_stat, CAST(p AS DOUBLE) AS p_value, ms AS mean_shift, ss AS std_shift, p < 0.05 OR ms > 0.2 OR ss > 0.2 AS drift_flag, ks + ms + ss AS drift_score, first_drift_ts FROM y)"
)
_DM = f"tag, n_ref, n_cur, {rs('ks_stat', 'p_value', 'mean_shift', 'std_shift')}, drift_flag, {rs('drift_score')}, first_drift_ts"


@query("d16_drift_metrics", f"WITH {SHIP}, {DRIFT} SELECT {_DM} FROM dm")
def _(spark, folder):
    """D16 to D18 in one table."""
    return drift.drift_metrics(shapes.ship_daily(spark, folder))


@query("f10_flag_then_fill", f"WITH {SHIP}, {DRIFT} SELECT {_DM} FROM dm ORDER BY dm.drift_flag DESC, dm.drift_score DESC, tag LIMIT 6")
def _(spark, folder):
    return drift.flag_then_fill(drift.drift_metrics(shapes.ship_daily(spark, folder)), 6)


@query("j14_drift_rank", f"WITH {SHIP}, {DRIFT} SELECT {_DM} FROM dm ORDER BY dm.drift_score DESC, tag LIMIT 5")
def _(spark, folder):
    return drift.drift_rank(drift.drift_metrics(shapes.ship_daily(spark, folder)), None, 5)


@query(
    "h14_drift_lead_score",
    f"WITH {SHIP}, {DRIFT} SELECT a.tag AS cause, b.tag AS target, round(CASE WHEN a.first_drift_ts < b.first_drift_ts THEN greatest(0.0, 1 - floor(date_diff('second', a.first_drift_ts, b.first_drift_ts) / 86400) / 20.0) ELSE 0.0 END, 6) + 0.0 AS lead "
    "FROM dm a JOIN dm b ON a.tag <> b.tag",
)
def _(spark, folder):
    m = drift.drift_metrics(shapes.ship_daily(spark, folder)).select("tag", "first_drift_ts")
    a = m.select(F.col("tag").alias("cause"), F.col("first_drift_ts").alias("a"))
    b = m.select(F.col("tag").alias("target"), F.col("first_drift_ts").alias("b"))
    return a.join(b, F.col("cause") != F.col("target")).select("cause", "target", drift_lead_score(F.col("a"), F.col("b")).alias("lead"))


_EDGES = (
    f"{PATHS}, tg AS (SELECT path, string_split(path, ' -> ') AS t FROM paths), "
    "ed AS (SELECT DISTINCT t[i] AS src, t[i + 1] AS dst FROM tg, range(1, 4) r(i) WHERE t[i] <> t[i + 1])"
)
TARGET = "3-MEDIUM"


@query("h1_split_path", f"WITH {PATHS} SELECT path, string_split(path, ' -> ') AS tags FROM paths")
def _(spark, folder):
    return causal.path_table(shapes.cause_paths(spark, folder))


@query("j1_graph_edges", f"WITH {_EDGES} SELECT src, dst FROM ed")
def _(spark, folder):
    return causal.graph_edges(shapes.cause_paths(spark, folder))


_CLOSE = "cl AS (SELECT src, dst FROM ed UNION SELECT cl.src, ed.dst FROM cl JOIN ed ON cl.dst = ed.src)"


@query("j2_closure", f"WITH RECURSIVE {_EDGES}, {_CLOSE} SELECT src, dst FROM cl WHERE src <> dst")
def _(spark, folder):
    return causal.closure(causal.graph_edges(shapes.cause_paths(spark, folder)))


@query("j2_ancestors", f"WITH RECURSIVE {_EDGES}, {_CLOSE} SELECT src AS tag FROM cl WHERE dst = '{TARGET}' AND src <> dst")
def _(spark, folder):
    return causal.ancestors(causal.graph_edges(shapes.cause_paths(spark, folder)), TARGET)


@query(
    "j3_paths_to_target",
    f"WITH RECURSIVE {_EDGES}, pt AS (SELECT src, [src, dst] AS path FROM ed WHERE dst = '{TARGET}' UNION ALL SELECT ed.src, list_prepend(ed.src, path) FROM pt JOIN ed ON ed.dst = pt.src WHERE NOT list_contains(path, ed.src) AND len(path) <= 6) "
    "SELECT src AS source, path FROM pt",
)
def _(spark, folder):
    return causal.paths_to_target(causal.graph_edges(shapes.cause_paths(spark, folder)), TARGET)


@query(
    "j4_target_relations",
    f"WITH RECURSIVE {_EDGES}, {_CLOSE}, nd AS (SELECT src AS tag FROM ed UNION SELECT dst FROM ed) SELECT tag, CASE WHEN EXISTS (FROM ed WHERE src = tag AND dst = 'BUILDING') THEN 'direct' "
    "WHEN EXISTS (FROM cl WHERE src = tag AND dst = 'BUILDING') THEN 'indirect' WHEN EXISTS (FROM cl WHERE src = 'BUILDING' AND dst = tag) THEN 'descendant' ELSE 'independent' END AS relation FROM nd WHERE tag <> 'BUILDING'",
)
def _(spark, folder):
    return causal.target_relations(causal.graph_edges(shapes.cause_paths(spark, folder)), "BUILDING")


@query(
    "j6_drift_children",
    f"WITH {_EDGES}, q AS (SELECT t, unnest(['ASIA', 'BUILDING', '3-MEDIUM']) AS tag FROM tg) SELECT DISTINCT tag, t[list_position(t, tag) + 1] AS child FROM q WHERE list_contains(t, tag) AND list_position(t, tag) < len(t)",
)
def _(spark, folder):
    drifted = spark.createDataFrame([("ASIA",), ("BUILDING",), ("3-MEDIUM",)], "tag string")
    return causal.drift_children(shapes.cause_paths(spark, folder), drifted)


@query(
    "j10_path_bonus",
    f"WITH {_EDGES}, q AS (SELECT path, t, list_position(t, '{TARGET}') AS p FROM tg WHERE list_contains(t, '{TARGET}')), u AS (SELECT path, t[p - 1] AS last, unnest(t[1:p - 1]) AS cause FROM q) "
    "SELECT cause, max(CASE WHEN cause = last THEN 1 ELSE 0 END)::BIGINT AS direct_bonus, max(CASE WHEN cause <> last THEN 1 ELSE 0 END)::BIGINT AS indirect_bonus, string_agg(DISTINCT path, ' | ' ORDER BY path) AS matched_paths FROM u GROUP BY cause",
)
def _(spark, folder):
    return causal.path_bonus(shapes.cause_paths(spark, folder), TARGET)


@query(
    "j11_propagation_paths",
    f"WITH {_EDGES}, c AS (SELECT unnest(['FRANCE', 'ASIA', 'nowhere']) AS cause), s AS (SELECT DISTINCT cause, array_to_string(t[list_position(t, cause):list_position(t, '{TARGET}')], ' -> ') AS pp FROM tg, c WHERE list_contains(t, cause) AND list_contains(t, '{TARGET}') AND list_position(t, cause) < list_position(t, '{TARGET}')) "
    f"SELECT cause, coalesce(pp, cause || ' -> {TARGET}') AS propagation_path, CASE WHEN pp IS NULL THEN 'Fallback' ELSE 'Example_Paths' END AS path_source FROM c LEFT JOIN s USING (cause)",
)
def _(spark, folder):
    causes = spark.createDataFrame([("FRANCE",), ("ASIA",), ("nowhere",)], "cause string")
    return causal.propagation_paths(shapes.cause_paths(spark, folder), causes, TARGET)


@query("j12_root_causes_paths")
def _(spark, folder):
    s = shapes.order_daily(spark, folder).stored()
    weights = models.model_attribution(s, models.candidates_of(models.pair_scores(s)).where(F.col("target") == TARGET))
    df = causal.root_causes_paths(s, shapes.cause_paths(spark, folder), TARGET, weights)
    return causal.cause_reasons(df).select("cause", "direct_score", "indirect_score", "root_score", "cause_type", "reason")


@query("j13_root_causes_graph")
def _(spark, folder):
    s = shapes.order_daily(spark, folder).stored()
    edges = causal.graph_edges(shapes.cause_paths(spark, folder))
    targets = settle(drift.drift_rank(drift.drift_metrics(s), None, 10).select("tag"))
    listed = models.candidates_of(models.pair_scores(s)).join(targets.select(F.col("tag").alias("target")), "target", "left_semi")
    df = causal.root_causes_graph(s, edges, targets, models.model_attribution(s, listed))
    return df.select("target", "cause", "relation", "final_score", "rank_order")


