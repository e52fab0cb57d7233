"""Roll-ups, comparisons, rankings and stores over classified readings."""

from pyspark.sql import functions as F

from catalog import sqlparts as sp
from catalog.base import PATHS, SENSOR, SHIP, USER, query, r, rs
from catalog.causal import DRIFT
from catalog.pairs import _PEERS
from sensorium.operators import detect, drift, regress, report, rows
from sensorium.sources import shapes, store

_ALL = "ac AS (SELECT DISTINCT ts, TRUE AS clean FROM ship)"
RES = sp.joined(SHIP, _ALL, sp.clean_limits("ship", "ac"), sp.z_classes("ship", "lim", "2.0", "2.5", "3.0"))


def _res(spark, folder):
    from sensorium.operators import limits

    s = shapes.ship_daily(spark, folder)
    every = s.df.groupBy("ts").agg(F.lit(True).alias("clean"))
    table = limits.fences(limits.clean_limits(s, every), F.lit(2.0), F.lit(2.5), F.lit(3.0))
    return s, detect.classify_results(s, table)


_BAD = "final_status = 'Abnormal'"
_CC = "count_if(final_class = 'Drift') AS drift_count, count_if(final_class = 'Drift + Anomaly') AS drift_anomaly_count, count_if(final_class = 'Strong Anomaly') AS strong_anomaly_count"


@query("d19_timestamp_summary", f"{RES} SELECT ts, count(DISTINCT tag) AS total_tags, count_if({_BAD}) AS abnormal_tags, {_CC}, {r('max(abs_z)', 'max_abs_z')}, {r('avg(abs_z)', 'mean_abs_z')}, CASE WHEN count_if({_BAD}) > 0 THEN 'Abnormal' ELSE 'Normal' END AS status FROM cls GROUP BY ts")
def _(spark, folder):
    return report.timestamp_summary(_res(spark, folder)[1])


_TS = f"ts_ AS (SELECT tag, count(*) AS total_rows, count_if({_BAD}) AS abnormal_count, count_if({_BAD}) / count(*) AS abnormal_rate, {_CC}, min(ts) FILTER ({_BAD}) AS first_abnormal_ts FROM cls GROUP BY tag)"


@query("d20_tag_summary", f"{RES}, {_TS} SELECT tag, total_rows, abnormal_count, {rs('abnormal_rate')}, drift_count, drift_anomaly_count, strong_anomaly_count, first_abnormal_ts FROM ts_")
def _(spark, folder):
    return report.tag_summary(_res(spark, folder)[1])


@query(
    "d21_daily_summary",
    f"{RES}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY abs_z DESC, tag) AS rn FROM cls WHERE {_BAD}) SELECT ts, count(*) AS abnormal_count, {r('max(abs_z)', 'max_severity')}, string_agg(tag, ', ' ORDER BY rn) FILTER (rn <= 8) AS top_tags FROM k GROUP BY ts",
)
def _(spark, folder):
    return report.daily_summary(_res(spark, folder)[1])


@query(
    "d22_event_pivot",
    f"{RES} SELECT ts, count_if(final_class = 'Normal') AS normal, count_if(final_class = 'Drift') AS drift, count_if(final_class = 'Contextual Anomaly') AS contextual_anomaly, count_if(final_class = 'Drift + Anomaly') AS drift_anomaly, count_if(final_class = 'Strong Anomaly') AS strong_anomaly, count_if(final_class <> 'Normal') AS total_abnormal FROM cls GROUP BY ts",
)
def _(spark, folder):
    return report.event_pivot(_res(spark, folder)[1])


@query(
    "d23_run_summary",
    f"{RES}, o AS (SELECT count(*)::DOUBLE AS \"Total_Result_Rows\", count(DISTINCT tag)::DOUBLE AS \"Total_Tags\", count(DISTINCT ts)::DOUBLE AS \"Total_Timestamps\", count_if(NOT {_BAD})::DOUBLE AS \"Normal_Rows\", count_if({_BAD})::DOUBLE AS \"Abnormal_Rows\", count_if({_BAD}) / count(*) AS \"Abnormal_Rate\", "
    "count_if(final_class = 'Drift')::DOUBLE AS \"Drift_Count\", count_if(final_class = 'Drift + Anomaly')::DOUBLE AS \"Drift_Anomaly_Count\", count_if(final_class = 'Strong Anomaly')::DOUBLE AS \"Strong_Anomaly_Count\" FROM cls) "
    f"SELECT metric, {rs('value')} FROM (UNPIVOT (FROM o) ON COLUMNS(*) INTO NAME metric VALUE value)",
)
def _(spark, folder):
    return report.run_summary(_res(spark, folder)[1])


# Labels: a plain 3-sigma rule with words to clean up.
_LAB = "lb AS (SELECT ts, tag, CASE WHEN abs_z >= 2.75 THEN 'Strong Anomaly' ELSE 'Normal' END AS label_class, CASE WHEN abs_z >= 2.75 THEN 'Abnormal' ELSE 'Normal' END AS label_binary FROM cls)"
_CMP = f"{RES}, {_LAB}, cp AS (SELECT cls.ts, cls.tag, final_class AS own_class, final_status AS own_status, label_class, label_binary FROM cls JOIN lb USING (ts, tag))"


def _compared(spark, folder):
    _, res = _res(spark, folder)
    labels = res.select(F.col("ts").alias("Time"), F.concat(F.lit(" "), "tag").alias("Sensor"), F.when(F.col("abs_z") >= 2.75, " Strong Anomaly").otherwise("OK").alias("Label"))
    return report.compare(res, rows.standardize_labels(labels, "Time", "Sensor", "Label"))


@query("c2_compare_results", f"{_CMP} SELECT * FROM cp")
def _(spark, folder):
    """C2 with B18 label clean-up."""
    return _compared(spark, folder)


_CONF = (
    "count_if(own_status = 'Abnormal' AND label_binary = 'Abnormal') AS tp, count_if(own_status <> 'Abnormal' AND label_binary <> 'Abnormal') AS tn, "
    "count_if(own_status = 'Abnormal' AND label_binary <> 'Abnormal') AS fp, count_if(own_status <> 'Abnormal' AND label_binary = 'Abnormal') AS fn"
)
_RATES = (
    f"tp, tn, fp, fn, {r('(tp + tn) / nullif(tp + tn + fp + fn, 0)', 'accuracy')}, {r('tp / nullif(tp + fp, 0)', 'precision')}, {r('tp / nullif(tp + fn, 0)', 'recall')}, {r('tn / nullif(tn + fp, 0)', 'specificity')}, "
    f"{r('2 * tp / nullif(2 * tp + fp + fn, 0)', 'f1')}, {r('fp / nullif(fp + tn, 0)', 'fpr')}, {r('fn / nullif(fn + tp, 0)', 'fnr')}"
)


@query("d24_confusion_summary", f"{_CMP}, q AS (SELECT {_CONF} FROM cp) SELECT {_RATES} FROM q")
def _(spark, folder):
    return report.confusion(_compared(spark, folder))


@query("d26_confusion_by_tag", f"{_CMP}, q AS (SELECT tag, {_CONF} FROM cp GROUP BY tag) SELECT tag, {_RATES} FROM q")
def _(spark, folder):
    return report.confusion(_compared(spark, folder), ["tag"])


@query("d26_match_by_timestamp", f"{_CMP} SELECT ts, count(*) AS compared, count_if(own_status = label_binary) AS matches, {r('count_if(own_status = label_binary) / count(*)', 'match_rate')} FROM cp GROUP BY ts")
def _(spark, folder):
    return report.match_by_timestamp(_compared(spark, folder))


@query("d25_crosstab_margins", f"{_CMP} SELECT coalesce(label_class, 'All') AS label_class, coalesce(own_class, 'All') AS own_class, count(*) AS n FROM cp GROUP BY CUBE (cp.label_class, cp.own_class)")
def _(spark, folder):
    return report.crosstab_margins(_compared(spark, folder))


@query("d27_class_counts", f"{RES} SELECT final_class, count(*) AS n FROM cls GROUP BY 1")
def _(spark, folder):
    return _res(spark, folder)[1].groupBy("final_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c12_diff_vs_global",
    f"{_CMP} SELECT count(*) AS compared, count_if(own_class <> label_class) AS changed_rows, count(DISTINCT CASE WHEN own_class <> label_class THEN tag END) AS changed_tags, {r('count_if(own_class <> label_class) / count(*)', 'changed_rate')} FROM cp",
)
def _(spark, folder):
    _, res = _res(spark, folder)
    other = res.withColumn("final_class", F.when(F.col("abs_z") >= 2.75, "Strong Anomaly").otherwise("Normal"))
    return report.class_diff(res, other)


@query("d28_day_tag_scores", f"{RES}, k AS (SELECT CAST(ts AS DATE) AS day, tag, count(*) + 1e-6::DOUBLE * sum(abs_z) AS drift_score FROM cls WHERE {_BAD} GROUP BY 1, 2) SELECT day, tag, {rs('drift_score')}, row_number() OVER (PARTITION BY day ORDER BY k.drift_score DESC, tag) AS rank_order FROM k")
def _(spark, folder):
    return report.day_tag_scores(_res(spark, folder)[1])


@query("d29_strong_by_day", f"{RES}, k AS (SELECT CAST(ts AS DATE) AS day, tag, count(*) AS strong_count FROM cls WHERE final_class = 'Strong Anomaly' GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY day ORDER BY strong_count DESC, tag) AS rank_order FROM k")
def _(spark, folder):
    return report.strong_by_day(_res(spark, folder)[1])


@query("d31_data_quality", f"{RES}, k AS (SELECT round(100.0::DOUBLE * count_if({_BAD}) / count(*), 2) AS p FROM cls) SELECT p AS flagged_pct, round(100 - p, 6) + 0.0 AS quality_pct, CASE WHEN p < 20 THEN 'Healthy' WHEN p <= 30 THEN 'Watch' ELSE 'Critical' END AS health FROM k")
def _(spark, folder):
    return report.data_quality(_res(spark, folder)[1])


@query(
    "d32_tag_analysis",
    f"{RES}, {_TS}, {DRIFT}, {_PEERS.replace('p AS (', 'p_ AS (').replace('FROM p UNION', 'FROM p_ UNION').replace('FROM p)', 'FROM p_)').replace(' d AS (SELECT tag_a', ' d_ AS (SELECT tag_a').replace('FROM d)', 'FROM d_)').replace(' k AS (SELECT *, row', ' k_ AS (SELECT *, row').replace('FROM k WHERE rank', 'FROM k_ WHERE rank')} "
    f"SELECT tag, CASE WHEN strong_anomaly_count > 0 THEN 'Strong Anomaly' WHEN drift_anomaly_count > 0 THEN 'Drift + Anomaly' WHEN drift_count > 0 THEN 'Drift' ELSE 'Normal' END AS status, {rs('drift_score')}, abnormal_count AS anomaly_count, "
    "(SELECT string_agg(peer, ', ' ORDER BY rank) FROM pe WHERE target = ts_.tag AND rank <= 4) AS peers FROM ts_ LEFT JOIN dm USING (tag)",
)
def _(spark, folder):
    s, res = _res(spark, folder)
    return report.tag_analysis(report.tag_summary(res), regress.peers_by_corr(s), drift.drift_metrics(s))


@query(
    "d33_tag_insights",
    f"{RES}, g AS (SELECT tag, limit_crossed AS why, min(ts) AS t FROM cls WHERE {_BAD} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY t, why) AS rn FROM g), "
    f"n AS (SELECT tag, count(*) AS flagged FROM cls WHERE {_BAD} GROUP BY tag) SELECT n.tag, flagged, (SELECT list(why ORDER BY rn) FROM k WHERE k.tag = n.tag AND rn <= 5) AS reasons FROM n",
)
def _(spark, folder):
    return report.tag_insights(_res(spark, folder)[1], "limit_crossed")


@query(
    "d30_points_summary",
    f"WITH {SHIP}, m AS (SELECT tag, avg(value) AS m, stddev_pop(value) AS s FROM ship GROUP BY tag), z AS (SELECT ts, tag, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS z FROM ship JOIN m USING (tag)), "
    "p AS (SELECT ts, count_if(abs(z) > 2) AS n FROM z GROUP BY ts), k AS (SELECT tag, abs(z) >= 2.5 AS o, n >= 2 AND abs(z) >= 1.5 AS pr, round(abs(z), 2) AS os FROM z JOIN p USING (ts)) "
    "SELECT tag, count_if(o AND NOT pr) AS outlier_only, count_if(pr AND NOT o) AS process_only, count_if(o AND pr) AS both, count(*) AS total, max(os) AS max_outlier_score FROM k WHERE o OR pr GROUP BY tag",
)
def _(spark, folder):
    return report.points_summary(detect.classify_points_simple(shapes.ship_daily(spark, folder)))


@query("d35_observation_bounds", f"WITH {USER} SELECT tag, min(ts) AS first_ts, max(ts) AS last_ts FROM users GROUP BY tag")
def _(spark, folder):
    return shapes.user_long(spark, folder).df.groupBy("tag").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("d36_observation_days", f"WITH {SENSOR} SELECT DISTINCT CAST(ts AS DATE) AS day FROM sensor ORDER BY day")
def _(spark, folder):
    return shapes.sensor_long(spark, folder).df.select(F.to_date("ts").alias("day")).distinct().orderBy("day")


@query("d37_plant_area_tree", "SELECT r_name AS plant, list(DISTINCT n_name ORDER BY n_name) AS areas FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, folder):
    region, nation = (shapes.table(spark, folder, t) for t in ("region", "nation"))
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.groupBy(F.col("r_name").alias("plant")).agg(F.sort_array(F.collect_set("n_name")).alias("areas"))


@query("f2_top_n_per_group", f"WITH {USER} SELECT tag, ts, {rs('value')} FROM users QUALIFY row_number() OVER (PARTITION BY tag ORDER BY value DESC, ts) <= 3")
def _(spark, folder):
    s = shapes.user_long(spark, folder).df.select("tag", "ts", "value")
    return report.top_n_per_group(s, ["tag"], [F.desc("value"), F.col("ts")], 3)


@query("f3_smallest_k", f"WITH {RES[5:]}, t AS (SELECT ts, max(abs_z) AS score FROM cls GROUP BY ts) SELECT ts, {rs('score')} FROM t QUALIFY row_number() OVER (ORDER BY t.score, ts) <= 40")
def _(spark, folder):
    from sensorium.operators.clean import smallest_k

    _, res = _res(spark, folder)
    return smallest_k(res.groupBy("ts").agg(F.max("abs_z").alias("score")), "score", F.lit(40), "_low").where("_low").select("ts", "score")


@query("f5_page", "SELECT o_orderkey, " + rs("o_totalprice") + " FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, folder):
    o = shapes.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return report.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 3)


@query("f7_latest_by", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, folder):
    return report.latest_by(shapes.table(spark, folder, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("f8_month_pages", f"{RES} SELECT tag, strftime(ts, '%Y-%m') AS month, count(*) AS rows, count_if({_BAD}) AS abnormal FROM cls GROUP BY 1, 2")
def _(spark, folder):
    return report.month_pages(_res(spark, folder)[1])


@query("f11_sample_rows")
def _(spark, folder):
    return report.sample_rows(shapes.sensor_long(spark, folder), 200).select("ts", "tag", "value")


_GRP = (
    "g0 AS (SELECT *, lag(ts) OVER (PARTITION BY tag ORDER BY ts) AS prev FROM cls WHERE final_status = 'Abnormal'), "
    "g1 AS (SELECT *, sum(CASE WHEN floor(date_diff('second', prev, ts) / 86400) <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY tag ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pid FROM g0)"
)


@query("e21_periods", f"{RES}, {_GRP} SELECT tag, CAST(pid AS BIGINT) AS period_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, {r('max(abs_z)', 'max_severity')}, {r('avg(abs_z)', 'avg_severity')}, arg_min(final_class, ts) AS first_class FROM g1 GROUP BY tag, pid")
def _(spark, folder):
    s, res = _res(spark, folder)
    return report.periods(s, res.where("final_status = 'Abnormal'"))


@query("c5_causal_rows", f"WITH {PATHS} SELECT DISTINCT trim(path) AS path FROM paths WHERE trim(path) <> ''")
def _(spark, folder):
    return store.causal_rows(shapes.cause_paths(spark, folder)).select("path")


@query("c6_tags_on_day", f"WITH {USER} SELECT DISTINCT tag FROM users WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, folder):
    s = shapes.user_long(spark, folder).df
    return s.select("tag").distinct().join(rows.filter_day(s, "2024-01-10"), "tag", "left_semi")


@query("c7_has_rows_in_range", "SELECT count(*) > 0 AS has_rows FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, folder):
    hit = rows.filter_day(shapes.sensor_long(spark, folder).df, "2024-01-10").limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("has_rows"))


@query(
    "c15_fill_calendar",
    "WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE value > 330 GROUP BY 1), m AS (SELECT max(day) AS last FROM c) SELECT CAST(d AS DATE) AS day, coalesce(n, 0) AS n FROM m, unnest(generate_series(CAST(last - 13 AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) g(d) LEFT JOIN c ON c.day = CAST(d AS DATE)",
)
def _(spark, folder):
    e = shapes.table(spark, folder, "events").where("value > 330")
    return report.fill_calendar(e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")))


@query("c17_allow_list_timestamps", f"WITH {SHIP} SELECT ts, tag, {rs('value')} FROM ship WHERE ts IN (SELECT ts FROM ship WHERE tag = 'qty_sum' AND value > 600)")
def _(spark, folder):
    s = shapes.ship_daily(spark, folder).df
    keep = s.where("tag = 'qty_sum' AND value > 600").select("ts")
    return s.join(keep, "ts", "left_semi").select("ts", "tag", "value")


# A job log read off the events: plant = event type, one status row per event.
_JOBS = (
    "jl AS (SELECT event_type AS plant, CAST(ts AS DATE) AS day, event_id AS seq, CASE WHEN value > 60 THEN 'failed' WHEN value > 20 THEN 'completed' WHEN value > 15 THEN 'skipped' ELSE 'running' END AS status FROM events), "
    "js AS (SELECT * FROM jl QUALIFY row_number() OVER (PARTITION BY plant, day ORDER BY seq DESC) = 1)"
)


def _jobs(spark, folder):
    v = F.col("value")
    status = F.when(v > 60, "failed").when(v > 20, "completed").when(v > 15, "skipped").otherwise("running")
    return shapes.table(spark, folder, "events").select(F.col("event_type").alias("plant"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), status.alias("status"))


@query("a22_mark_job", f"WITH {_JOBS} SELECT plant, day, seq, status FROM js")
def _(spark, folder):
    """A22 and C18: newest status of each job of an append-only log."""
    return store.job_status(_jobs(spark, folder))


@query("d55_dataset_status", f"WITH {_JOBS} SELECT DISTINCT plant, day FROM jl WHERE (plant, day) NOT IN (SELECT (plant, day) FROM js WHERE status IN ('completed', 'skipped'))")
def _(spark, folder):
    jobs = _jobs(spark, folder)
    return store.next_days(jobs, jobs)


@query("g3_except_tags", f"WITH {USER} SELECT DISTINCT tag FROM users WHERE tag NOT IN (SELECT tag FROM users WHERE value > 250)")
def _(spark, folder):
    s = shapes.user_long(spark, folder).df
    return s.select("tag").distinct().join(s.where("value > 250").select("tag"), "tag", "left_anti")


@query("g4_intersect_tags", f"WITH {USER} SELECT tag FROM users WHERE value > 250 INTERSECT SELECT tag FROM users WHERE value < 1")
def _(spark, folder):
    s = shapes.user_long(spark, folder).df
    return s.where("value > 250").select("tag").intersect(s.where("value < 1").select("tag"))
