"""Consensus, peer regression and fusion."""

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import sqlparts as sp
from catalog.base import SENSOR, SHIP, W, center_scale, query, rs
from catalog.detect import deviation_inside_sql
from catalog.limits import baseline_sql
from catalog.pairs import _corr
from catalog.windows import _EARLY
from sensorium.operators import consensus, contextual, detect
from sensorium.sources import shapes


def _f(back: int, ahead: int) -> str:
    return f"OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"


def _med(col: str, back: int, ahead: int, need: int) -> str:
    return f"CASE WHEN count({col}) {_f(back, ahead)} >= {need} THEN quantile_cont({col}, 0.5) {_f(back, ahead)} END"


def signals_sql(src: str, multi: bool) -> str:
    """CTE ``sg``: z values of all signals but the peer one."""
    parts = [baseline_sql(src, "0.15" if multi else None)]
    m = f"q0 AS (SELECT s.*, value - lag(value) OVER ({W}) AS dlt, {_med('value', 15, 15, 11)} AS lm"
    if multi:
        m += f", {_med('value', 71, 0, 24)} AS tm, {_med('value', 8, 0, 4)} AS sm"
    parts.append(m + f" FROM {src} s)")
    parts.append("q1 AS (SELECT *, abs(value - lm) AS ld" + (", abs(value - tm) AS td, sm - tm AS gap" if multi else "") + " FROM q0)")
    parts.append(f"q2 AS (SELECT *, {_med('ld', 15, 15, 11)} AS ls" + (f", {_med('td', 71, 0, 24)} AS tl" if multi else "") + " FROM q1)")
    extra, joins = "NULL::DOUBLE AS z_long, NULL::DOUBLE AS z_gap, NULL::DOUBLE AS z_early", ""
    if multi:
        parts.append(center_scale("q2", "gap", "gc", "floor"))
        parts.append(_EARLY.replace("FROM sensor", f"FROM {src}"))
        parts.append(center_scale("e0", "early", "ec", "floor"))
        extra = (
            "CASE WHEN tl IS NOT NULL THEN (value - tm) / greatest(1.4826 * tl, 1e-9) END AS z_long, CASE WHEN gc.scale > 1e-9 THEN gap / gc.scale END AS z_gap, "
            "CASE WHEN ec.n >= 30 AND ec.scale > 1e-9 THEN (value - ec.center) / ec.scale END AS z_early"
        )
        joins = " JOIN gc USING (tag) JOIN ec USING (tag)"
    parts.append(
        "sg AS (SELECT q2.ts, q2.row_index, q2.tag, value, bl.* EXCLUDE (tag), CASE WHEN mad_scale > 1e-9 THEN (value - median) / mad_scale END AS z_global, "
        "CASE WHEN ls IS NOT NULL THEN (value - lm) / greatest(1.4826 * ls, 1e-9) END AS z_local, CASE WHEN diff_scale > 1e-9 THEN dlt / diff_scale END AS z_diff, "
        f"off_mode AND abs(value) <= off_floor AS off_state, {extra} FROM q2 JOIN bl USING (tag){joins})"
    )
    return ", ".join(parts)


def vote_sql(multi: bool, ratio: str = "1.0", engines: bool = False, peer: bool = False) -> str:
    """CTE ``vt``: fired counts and class; with ``peer`` the signal of ``s5`` votes too, and weighs more."""
    k = dict(g=3.75, l=3.75, f=2.75, d=4.5, p=3.75, strict=3) if multi else dict(g=4.0, l=4.0, f=3.0, d=5.0, p=4.0, strict=4)
    src = "sg" + (" LEFT JOIN ctl USING (tag)" if engines else "") + (" LEFT JOIN s5 USING (tag, ts)" if peer else "")

    def fire(name: str, cond: str, z: str | None) -> str:
        if engines:
            direction = {None: "TRUE"}.get(z, f"CASE WHEN dir = 'up' THEN {z} > 0 WHEN dir = 'down' THEN {z} < 0 ELSE TRUE END")
            cond = f"({cond}) AND {direction} AND (eng IS NULL OR list_contains(eng, '{name}'))"
        return f"CASE WHEN NOT off_state AND coalesce({cond}, FALSE) THEN 1 ELSE 0 END"

    low, high = f"value < q1 - {k['f']} * {ratio} * iqr", f"value > q3 + {k['f']} * {ratio} * iqr"
    outside = f"{low} OR {high}"
    if engines:
        outside = f"CASE WHEN dir = 'up' THEN {high} WHEN dir = 'down' THEN {low} ELSE {outside} END"
    fires = [
        fire("S1_GLOBAL", f"abs(z_global) >= {k['g']} * {ratio}", "z_global"),
        fire("S2_LOCAL", f"abs(z_local) >= {k['l']} * {ratio}", "z_local"),
        fire("S3_TUKEY", outside, None),
        fire("S4_DIFF", f"abs(z_diff) >= {k['d']} * {ratio}", "z_diff"),
    ]
    if multi:
        fires += [
            fire("S6_LONG", f"abs(z_long) >= 3.15 * {ratio}", "z_long"),
            fire("S7_TREND", f"abs(z_gap) >= 2.85 * {ratio}", "z_gap"),
            fire("S8_EARLY", f"abs(z_early) >= 2.95 * {ratio}", "z_early"),
            fire("S8_EARLY", f"abs(z_early) >= 3.55 * {ratio}", "z_early"),
        ]
    five = fire("S5_PEER", f"abs(z_peer) >= {k['p']} * {ratio}", "z_peer") if peer else "0"
    fires.append(five)
    more = ", coalesce(s5.predicted, median) AS predicted, z_peer" if peer else ""
    return (
        f"vt0 AS (SELECT sg.*{more}, {five} AS f5, {' + '.join(fires)} AS fired FROM {src}), "
        f"vt1 AS (SELECT *, CASE WHEN off_state THEN 'Normal' WHEN fired >= {k['strict']} OR (f5 = 1 AND fired >= 3) THEN 'Actual Outlier' WHEN fired >= 2 THEN 'Warning' ELSE 'Normal' END AS c0, "
        f"sum(CASE WHEN fired >= 2 THEN 1 ELSE 0 END) {_f(2, 2)} AS near FROM vt0), "
        "vt AS (SELECT *, CASE WHEN c0 = 'Actual Outlier' AND near <= 1 AND fired < 4 THEN 'Warning' ELSE c0 END AS final_class FROM vt1)"
    )


_Z = ["z_global", "z_local", "z_diff", "z_long", "z_gap", "z_early"]
_SEL = f" SELECT ts, tag, {rs('value', *_Z)}, off_state, CAST(fired AS BIGINT) AS signals_fired, final_class FROM vt"
_NAMES = ["ts", "tag", "value", *_Z, "off_state", "signals_fired", "final_class"]

for _multi, _name in ((False, "i17_consensus_no_peer"), (True, "i18_multi_signal_no_peer")):

    @query(_name, sp.joined(SENSOR, signals_sql("sensor", _multi), vote_sql(_multi)) + _SEL, digits=5)
    def _(spark, folder, multi=_multi):
        cfg = consensus.MULTI_SIGNAL if multi else consensus.CONSERVATIVE
        return consensus.consensus(shapes.sensor_long(spark, folder), consensus.without_peers(cfg)).select(*_NAMES)


@query("i18_multi_signal_off_mode", sp.joined(SHIP, signals_sql("ship", True), vote_sql(True)) + f" SELECT tag, final_class, count(*) AS n, count_if(off_state) AS n_off FROM vt GROUP BY ALL")
def _(spark, folder):
    df = consensus.consensus(shapes.ship_daily(spark, folder), consensus.without_peers(consensus.MULTI_SIGNAL))
    return df.groupBy("tag", "final_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("off_state").alias("n_off"))


# The default peers need a forest; with peers by correlation alone SQL states the peer signal too.
for _multi, _name, _least, _k in ((False, "i17_consensus_corr_peers", 0.35, 4.0), (True, "i18_multi_signal_corr_peers", 0.30, 3.75)):

    @query(
        _name,
        sp.joined(SHIP, signals_sql("ship", _multi), sp.ridge_signal("ship", _corr("ship"), _least, _k), vote_sql(_multi, peer=True))
        + f" SELECT ts, tag, {rs('value')}, round(predicted, 4) + 0.0 AS predicted, round(z_peer, 4) + 0.0 AS z_peer, f5 = 1 AS fire_s5_peer, CAST(fired AS BIGINT) AS signals_fired, final_class FROM vt",
    )
    def _(spark, folder, multi=_multi):
        cfg = replace(consensus.MULTI_SIGNAL if multi else consensus.CONSERVATIVE, dynamic_peers=False)
        df = consensus.consensus(shapes.ship_daily(spark, folder).stored(), cfg)
        df = df.withColumns({"predicted": F.round("predicted", 4), "z_peer": F.round("z_peer", 4)})
        return df.select("ts", "tag", "value", "predicted", "z_peer", "fire_s5_peer", "signals_fired", "final_class")


@query("i17_consensus")
def _(spark, folder):
    """With the peers that a forest picks."""
    df = consensus.consensus(shapes.ship_daily(spark, folder).stored(), consensus.CONSERVATIVE)
    return df.select("ts", "tag", "value", "predicted", "z_peer", "fire_s5_peer", "signals_fired", "signals_testable", "final_class")


@query("i18_multi_signal")
def _(spark, folder):
    """With the peers that a forest picks."""
    cfg = consensus.MULTI_SIGNAL
    df = consensus.reason_text(consensus.consensus(shapes.ship_daily(spark, folder).stored(), cfg), cfg)
    return df.select("ts", "tag", "value", "predicted", "z_peer", "signals_fired", "signals_testable", "final_class", "reason")


# Controls of the five event tags.
CONTROLS = [
    ("click", 4.5, None, "up"),
    ("error", None, ["S1_GLOBAL", "S2_LOCAL", "S3_TUKEY"], "both"),
    ("purchase", 3.0, ["S4_DIFF", "S6_LONG", "S8_EARLY"], "down"),
    ("signup", None, None, "down"),
    ("view", 3.375, [], "both"),
]
_CTL = "ctl AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {('%s' % th) if th else 'NULL'}, {e if e else 'NULL::VARCHAR[]'}, '{d}')" for t, th, e, d in CONTROLS
) + ") c(tag, th, eng, dir))"


@query(
    "i19_apply_tag_controls",
    sp.joined(SENSOR, _CTL, signals_sql("sensor", True), vote_sql(True, "coalesce(th / 3.75, 1.0)", True)) + f" SELECT ts, tag, {rs('value')}, CAST(fired AS BIGINT) AS signals_fired, final_class FROM vt",
)
def _(spark, folder):
    controls = spark.createDataFrame(CONTROLS, consensus.CONTROL_FIELDS)
    cfg = consensus.without_peers(consensus.MULTI_SIGNAL)
    df = consensus.consensus(shapes.sensor_long(spark, folder), cfg, controls)
    return df.select("ts", "tag", "value", "signals_fired", "final_class")


# Controls of four of the daily tags.
SHIP_CONTROLS = [
    ("qty_sum", 3.0, None, "both"),
    ("line_count", 5.0, ["S1_GLOBAL", "S5_PEER", "S6_LONG"], "up"),
    ("price_avg", None, ["S5_PEER", "S2_LOCAL"], "down"),
    ("qty_A_F", None, None, "up"),
]
_SHIP_CTL = "ctl AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {('%s' % th) if th else 'NULL'}, {e if e else 'NULL::VARCHAR[]'}, '{d}')" for t, th, e, d in SHIP_CONTROLS
) + ") c(tag, th, eng, dir))"


@query(
    "i19_apply_tag_controls_peers",
    sp.joined(SHIP, _SHIP_CTL, signals_sql("ship", True), sp.ridge_signal("ship", _corr("ship"), 0.30, 3.75), vote_sql(True, "coalesce(th / 3.75, 1.0)", True, True))
    + f" SELECT ts, tag, {rs('value')}, f5 = 1 AS fire_s5_peer, CAST(fired AS BIGINT) AS signals_fired, final_class FROM vt",
)
def _(spark, folder):
    controls = spark.createDataFrame(SHIP_CONTROLS, consensus.CONTROL_FIELDS)
    df = consensus.consensus(shapes.ship_daily(spark, folder).stored(), replace(consensus.MULTI_SIGNAL, dynamic_peers=False), controls)
    return df.select("ts", "tag", "value", "fire_s5_peer", "signals_fired", "final_class")


@query("i11_top5_regression")
def _(spark, folder):
    df = contextual.top5_regression(shapes.ship_daily(spark, folder))
    return df.select("ts", "tag", "value", "predicted", "residual_z", "value_z", "peer_shift", "range_position", "final_class", "severity")


# The model class is stated on plain percentiles here, so that SQL can state the fusion too.
_PCT = (
    "pc AS (SELECT tag, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ship GROUP BY tag), "
    "md AS (SELECT ts, ship.tag, value, CASE WHEN value < lo OR value > hi THEN 'Drift' ELSE 'Normal' END AS final_class FROM ship JOIN pc USING (tag) WHERE ship.tag <> 'tax_avg')"
)
_RANK = "CASE {} WHEN 'Strong Anomaly' THEN 4 WHEN 'Drift + Anomaly' THEN 3 WHEN 'Contextual Anomaly' THEN 2 WHEN 'Drift' THEN 1 ELSE 0 END"


@query(
    "c3_fuse_join",
    sp.joined(SHIP, sp.auto_clean("ship"), sp.clean_limits("ship", "ac"), sp.z_classes("ship", "lim"), sp.stable_run("ship").replace("sr AS", "sr2 AS"), sp.clean_like("ship").replace("JOIN sr USING", "JOIN sr2 USING").replace("sr.clean", "sr2.clean"), deviation_inside_sql("ship"), _PCT)
    + ", fj AS (SELECT coalesce(cls.ts, v5.ts, md.ts) AS ts, coalesce(cls.tag, v5.tag, md.tag) AS tag, coalesce(cls.value, v5.value, md.value) AS value, coalesce(cls.final_class, 'Normal') AS c1, coalesce(v5.final_class, 'Normal') AS c2, coalesce(md.final_class, 'Normal') AS c3 "
    "FROM cls FULL JOIN v5 ON cls.ts = v5.ts AND cls.tag = v5.tag FULL JOIN md ON md.ts = coalesce(cls.ts, v5.ts) AND md.tag = coalesce(cls.tag, v5.tag)), "
    f"fr AS (SELECT *, greatest({_RANK.format('c1')}, {_RANK.format('c2')}, {_RANK.format('c3')}) AS top FROM fj) "
    f"SELECT ts, tag, {rs('value')}, c1 AS class_1, c2 AS class_2, c3 AS class_3, ['Normal', 'Drift', 'Contextual Anomaly', 'Drift + Anomaly', 'Strong Anomaly'][top + 1] AS final_class FROM fr",
)
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    cut = s.quantiles({"lo": ("value", 0.05), "hi": ("value", 0.95)})
    model = s.attach(cut).where("tag <> 'tax_avg'")
    model = model.withColumn("final_class", F.when((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), "Drift").otherwise("Normal"))
    df = contextual.detect_fused(detect.auto_clean(s), detect.deviation_inside(s), model)
    return df.select("ts", "tag", "value", "class_1", "class_2", "class_3", "final_class")


@query("i12_detect_fused")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder)
    df = contextual.detect_fused(detect.auto_clean(s), detect.deviation_inside(s), contextual.top5_regression(s))
    return df.select("ts", "tag", "value", "class_1", "class_2", "class_3", "final_class", "rationale")


