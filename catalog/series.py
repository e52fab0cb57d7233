"""Reading, shaping and filtering series."""

from pyspark.sql import functions as F

from catalog.base import HOURLY, ORDERS, PATHS, SENSOR, SHIP, SHIP_TAGS, SHIPW, USER, query, r, rs, scratch_folder
from sensorium.functions.scalar import to_number
from sensorium.operators import rows
from sensorium.sources import ingest, shapes, store, wide

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("a1_read_series_csv", f"WITH {ORDERS} SELECT ts, tag, {rs('value')} FROM ords")
def _(spark, folder):
    """Readings written as CSV, then read, detected and cleaned without being told the layout."""
    out = scratch_folder(spark)
    shapes.order_daily(spark, folder).df.select("ts", "tag", "value").write.mode("overwrite").option("header", True).csv(f"{out}/long.csv")
    return ingest.load_series(ingest.read_series(spark, f"{out}/long.csv")).df.select("ts", "tag", "value")


@query("a19_load_wide", f"WITH {SHIP} SELECT ts, tag, {rs('value')} FROM ship")
def _(spark, folder):
    return ingest.load_series(shapes.ship_wide(spark, folder)).df.select("ts", "tag", "value")


@query("a6_detect_tag_cols", f"SELECT unnest({SHIP_TAGS}) AS tag")
def _(spark, folder):
    df = shapes.ship_wide(spark, folder)
    return spark.createDataFrame([(t,) for t in ingest.detect_tag_cols(df, ingest.detect_timestamp_col(df))], "tag string")


@query("a9_wide_to_observations", f"WITH {SHIP} SELECT ts, tag, {rs('value')} FROM ship")
def _(spark, folder):
    return wide.to_observations(shapes.ship_wide(spark, folder), SHIP_TAGS)


@query("a20_to_long", f"WITH {SHIP} SELECT ts, tag, {rs('value')} FROM ship WHERE value IS NOT NULL")
def _(spark, folder):
    return wide.to_long(shapes.ship_wide(spark, folder), "ts", SHIP_TAGS)


_PIV = ", ".join(r(f"avg(value) FILTER (tag = '{t}')", t) for t in TYPES)


@query("d1_pivot_mean", f"WITH {HOURLY} SELECT ts, {_PIV} FROM hourly GROUP BY ts")
def _(spark, folder):
    return wide.pivot_mean(shapes.sensor_hourly(spark, folder).df)


_END = "2024-01-15"
_OBS = "obs AS (SELECT 7::BIGINT AS dataset_id, date_trunc('hour', ts) AS row_index, event_type AS tag, value, ts AS observed_at, event_id AS seq FROM events)"


def _observations(spark, folder):
    e = shapes.table(spark, folder, "events")
    return e.select(
        F.lit(7).cast("long").alias("dataset_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("row_index"), F.col("event_type").alias("tag"), "value", F.col("ts").alias("observed_at"), F.col("event_id").alias("seq")
    )


@query(
    "a7_load_wide_before",
    f"WITH {_OBS}, k AS (SELECT * FROM obs WHERE dataset_id = 7 AND observed_at < TIMESTAMP '{_END}') SELECT row_index, min(observed_at) AS ts, "
    + ", ".join(f"count(*) FILTER (tag = '{t}' AND value IS NOT NULL) > 0 AS has_{t}" for t in TYPES)
    + " FROM k GROUP BY row_index",
)
def _(spark, folder):
    df = wide.load_wide_before(_observations(spark, folder), 7, _END, TYPES)
    return df.select("row_index", "ts", *[F.col(t).isNotNull().alias(f"has_{t}") for t in TYPES])


@query(
    "a8_observations_to_wide",
    f"WITH {_OBS}, k AS (SELECT dataset_id, row_index, tag, value, row_index AS observed_at, seq FROM obs) SELECT row_index, observed_at, "
    + ", ".join(r(f"arg_max(value, seq) FILTER (tag = '{t}')", t) for t in TYPES)
    + " FROM k GROUP BY ALL",
)
def _(spark, folder):
    return wide.observations_to_wide(_observations(spark, folder).withColumn("observed_at", F.col("row_index")), TYPES)


@query("a10_list_observations", f"WITH {SENSOR} SELECT ts, row_index, tag, {rs('value')} FROM sensor WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts, row_index, tag")
def _(spark, folder):
    return shapes.sensor_long(spark, folder).df.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).orderBy("ts", "row_index", "tag")


@query("a11_register_dataset", "SELECT 7::BIGINT AS dataset_id, count(*) AS n FROM events")
def _(spark, folder):
    """The dataset is new to an empty registry and known to its own one."""
    obs = _observations(spark, folder)
    known = store.dataset_hash(obs)
    again = store.new_datasets(obs, known).select("dataset_id")
    fresh = store.new_datasets(obs, known.where("false")).select("dataset_id")
    sizes = obs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return fresh.join(sizes, "dataset_id").join(again, "dataset_id", "left_anti")


_HIGH = "value > 100"


@query(
    "a12_upsert_observations",
    f"SELECT event_id, {r(f'CASE WHEN {_HIGH} THEN value / 2 ELSE value END', 'value')} FROM events",
)
def _(spark, folder):
    e = shapes.table(spark, folder, "events").select("event_id", "value")
    changes = e.where(_HIGH).withColumn("value", F.col("value") / 2)
    return store.upserted(e, changes, ["event_id"])


@query("a13_ingest_causal_rows", f"WITH {PATHS} SELECT path, " + "'{\"path\":\"' || path || '\"}' AS row_payload FROM paths")
def _(spark, folder):
    return store.causal_rows(shapes.cause_paths(spark, folder))


@query(
    "a15_replace_run_children",
    "SELECT event_type AS run_id, count(*) AS n, " + r("sum(CASE WHEN event_type = 'view' THEN value + 1 ELSE value END)", "total") + " FROM events GROUP BY 1",
    digits=3,
)
def _(spark, folder):
    """A14 and A15: runs appended as partitions, then one of them replaced."""
    out = scratch_folder(spark)
    e = shapes.table(spark, folder, "events").select(F.col("event_type").alias("run_id"), "event_id", "value")
    store.append_run(e, f"{out}/points")
    store.replace_children(e.where("run_id = 'view'").withColumn("value", F.col("value") + 1), f"{out}/points")
    return spark.read.parquet(f"{out}/points").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("a16_write_result_set", f"WITH {USER}, s AS (SELECT tag, count(*) AS n, max(value) AS top FROM users GROUP BY tag) SELECT tag, n, {rs('top')} FROM s")
def _(spark, folder):
    out = scratch_folder(spark)
    s = shapes.user_long(spark, folder).df
    store.export_tables({"tags": s.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))}, out)
    return spark.read.schema("tag string, n long, top double").option("header", True).csv(f"{out}/tags")


@query("a18_store_raw_rows", "SELECT 7::BIGINT AS dataset_id, 'nation' AS sheet, n_nationkey::BIGINT AS row_key, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS row_data FROM nation")
def _(spark, folder):
    """A18 and H15: uploaded rows as JSON."""
    return store.raw_rows(shapes.table(spark, folder, "nation"), 7, "nation", "n_nationkey")


@query("b1_to_number", "SELECT doc_id, TRY_CAST(lang AS DOUBLE) AS a, TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) AS b FROM documents")
def _(spark, folder):
    d = shapes.table(spark, folder, "documents")
    return d.select("doc_id", to_number("lang").alias("a"), to_number(F.col("n_chars").cast("string")).alias("b"))


@query(
    "b2_parse_timestamp",
    "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS iso, CAST(date_trunc('day', ts) AS TIMESTAMP) AS us, CAST(date_trunc('day', ts) AS TIMESTAMP) AS serial, "
    "CAST(date_trunc('second', ts) AS TIMESTAMP) AS secs, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS millis, NULL::TIMESTAMP AS small FROM events",
)
def _(spark, folder):
    e = shapes.table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id",
        ingest.parse_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iso"),
        ingest.parse_timestamp(F.date_format("ts", "M/d/yyyy")).alias("us"),
        ingest.parse_timestamp(F.date_diff("ts", F.lit("1899-12-30").cast("date")).cast("string")).alias("serial"),
        ingest.parse_timestamp(F.floor(us / 1_000_000).cast("string")).alias("secs"),
        ingest.parse_timestamp(F.floor(us / 1000).cast("string")).alias("millis"),
        ingest.parse_timestamp(F.col("value").cast("string")).alias("small"),
    )


@query("b3_filter_date_range", f"WITH {SENSOR} SELECT ts, tag, {rs('value')} FROM sensor WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def _(spark, folder):
    return rows.filter_date_range(shapes.sensor_long(spark, folder).df, "2024-01-05", "2024-01-12").select("ts", "tag", "value")


for _span, _months in (("3m", 3), ("6m", 6), ("1y", 12)):

    @query(f"b5_filter_duration_{_span}", f"WITH {ORDERS} SELECT ts, tag, {rs('value')} FROM ords WHERE ts >= (SELECT max(ts) FROM ords) - INTERVAL {_months} MONTH")
    def _(spark, folder, span=_span):
        """B4 and B5."""
        return rows.filter_duration(shapes.order_daily(spark, folder).df, span).select("ts", "tag", "value")


@query("b6_filter_through_day", f"WITH {SENSOR} SELECT ts, tag, {rs('value')} FROM sensor WHERE ts < TIMESTAMP '2024-01-11'")
def _(spark, folder):
    return rows.filter_through_day(shapes.sensor_long(spark, folder).df, "2024-01-10").select("ts", "tag", "value")


@query("b7_filter_day", f"WITH {SENSOR} SELECT ts, tag, {rs('value')} FROM sensor WHERE CAST(ts AS DATE) = DATE '2024-01-10'")
def _(spark, folder):
    return rows.filter_day(shapes.sensor_long(spark, folder).df, "2024-01-10").select("ts", "tag", "value")


@query(
    "b8_drop_rows_where",
    f"WITH {SHIPW} SELECT ts, {rs('qty_sum', 'line_count')} FROM shipw WHERE NOT (qty_sum > 900 OR line_count <= 15 OR qty_A_F BETWEEN 100 AND 120 OR abs(qty_N_O - 0) <= 1e-8)",
)
def _(spark, folder):
    rules = [
        {"status_tag": "qty_sum", "operator": ">", "value": 900},
        {"status_tag": "line_count", "operator": "<=", "value": "15"},
        {"status_tag": "qty_A_F", "operator": "between", "value": 100, "upper": 120},
        {"status_tag": "qty_N_O", "operator": "==", "value": 0},
        {"status_tag": "absent", "operator": ">", "value": 0},
    ]
    return rows.drop_rows_where(shapes.ship_wide(spark, folder), rules).select("ts", "qty_sum", "line_count")


@query("b9_drop_shutdown_rows", f"WITH {SHIP} SELECT ts, tag, {rs('value')} FROM ship WHERE ts NOT IN (SELECT ts FROM ship WHERE tag IN ('qty_A_F', 'qty_R_O') AND value <= 1e-6)")
def _(spark, folder):
    return rows.drop_shutdown_rows(shapes.ship_daily(spark, folder), ["qty_A_F", "qty_R_O"]).df.select("ts", "tag", "value")


@query("b10_drop_all_null", f"WITH {SHIPW} SELECT ts, {rs('qty_sum')} FROM shipw WHERE qty_sum > 500")
def _(spark, folder):
    w = shapes.ship_wide(spark, folder).select(
        "ts", F.when(F.col("qty_sum") > 500, F.col("qty_sum")).alias("qty_sum"), F.lit(None).cast("double").alias("empty")
    )
    return rows.drop_empty(w, ["qty_sum", "empty"])


@query(
    "b12_keep_critical_tags",
    f"WITH {USER}, s AS (SELECT tag, count(*) AS n FROM users WHERE value > 250 GROUP BY tag), c AS (SELECT unnest(['1', '2', '3', '4', 'missing']) AS tag) SELECT tag, coalesce(n, 0) AS n FROM c LEFT JOIN s USING (tag) WHERE EXISTS (FROM users SEMI JOIN c USING (tag)) "
    "UNION ALL SELECT tag, n FROM s WHERE NOT EXISTS (FROM users SEMI JOIN c USING (tag))",
)
def _(spark, folder):
    users = shapes.user_long(spark, folder).df
    s = users.where("value > 250").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.keep_critical_tags(s, ["1", "2", "3", "4", "missing"], ["n"], users)


@query("b15_normalize_day", "SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) AS b FROM events")
def _(spark, folder):
    e = shapes.table(spark, folder, "events")
    return e.select("event_id", rows.normalize_day(F.date_format("ts", "yyyy-MM-dd")).alias("a"), rows.normalize_day(F.date_format("ts", "M/d/yyyy")).alias("b"))


@query("b16_validate_timestamps", "SELECT count(*) AS parseable, 0::BIGINT AS bad FROM events")
def _(spark, folder):
    return ingest.validate_timestamps(shapes.table(spark, folder, "events").select(F.col("ts").cast("string").alias("t")), "t")


@query(
    "b19_median_fill",
    f"WITH {HOURLY}, t AS (SELECT DISTINCT ts FROM hourly WHERE tag = 'click'), g AS (SELECT t.ts, k.tag, h.value FROM t CROSS JOIN (SELECT DISTINCT tag FROM hourly) k LEFT JOIN hourly h ON h.ts = t.ts AND h.tag = k.tag), "
    f"m AS (SELECT tag, median(value) AS m FROM g GROUP BY tag) SELECT ts, g.tag, {r('coalesce(value, m, 0)', 'value')} FROM g JOIN m USING (tag)",
)
def _(spark, folder):
    return rows.median_fill(shapes.sensor_hourly(spark, folder), "click")


@query("b20_drop_constant_tags", f"WITH {USER}, s AS (SELECT tag FROM users GROUP BY tag HAVING stddev_samp(value) >= 1e-12) SELECT tag, count(*) AS n FROM users WHERE tag IN (FROM s) GROUP BY tag")
def _(spark, folder):
    return rows.drop_constant_tags(shapes.user_long(spark, folder)).df.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
