"""Roll-ups, comparisons, rankings and periods over classified readings (``ts, tag, value, final_class, final_status, abs_z``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorium.functions.classes import LADDER
from sensorium.functions.scalar import count_of, micros
from sensorium.series import Series

def _class_counts() -> list[Column]:
    c = F.col("final_class")
    return [
        count_of(c == "Drift").alias("drift_count"),
        count_of(c == "Drift + Anomaly").alias("drift_anomaly_count"),
        count_of(c == "Strong Anomaly").alias("strong_anomaly_count"),
    ]


def timestamp_summary(results: DataFrame) -> DataFrame:
    """Per timestamp: tags, abnormal tags, class counts, largest and mean |z|, status."""
    df = results.groupBy("ts").agg(
        F.count_distinct("tag").alias("total_tags"),
        count_of(F.col("final_status") == "Abnormal").alias("abnormal_tags"),
        *_class_counts(),
        F.max("abs_z").alias("max_abs_z"),
        F.avg("abs_z").alias("mean_abs_z"),
    )
    return df.withColumn("status", F.when(F.col("abnormal_tags") > 0, "Abnormal").otherwise("Normal"))


def tag_summary(results: DataFrame) -> DataFrame:
    """Per tag: rows, abnormal rows and rate, class counts, first abnormal time."""
    bad = F.col("final_status") == "Abnormal"
    return results.groupBy("tag").agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_of(bad).alias("abnormal_count"),
        (count_of(bad) / F.count(F.lit(1))).alias("abnormal_rate"),
        *_class_counts(),
        F.min(F.when(bad, F.col("ts"))).alias("first_abnormal_ts"),
    )


def daily_summary(results: DataFrame, top: int = 8) -> DataFrame:
    """Per timestamp: abnormal count, largest |z| and its worst tags as text (one reading per tag and time)."""
    bad = results.where("final_status = 'Abnormal'")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("abs_z")).alias("s"), "tag")))
    return bad.groupBy("ts").agg(
        F.count(F.lit(1)).alias("abnormal_count"),
        F.max("abs_z").alias("max_severity"),
        F.array_join(F.transform(F.slice(listed, 1, top), lambda s: s["tag"]), ", ").alias("top_tags"),
    )


def event_pivot(results: DataFrame) -> DataFrame:
    """Timestamp × class counts with every class, and the abnormal total."""
    counts = [count_of(F.col("final_class") == c).alias(c.lower().replace(" + ", "_").replace(" ", "_")) for c in LADDER]
    df = results.groupBy("ts").agg(*counts, count_of(F.col("final_class") != "Normal").alias("total_abnormal"))
    return df


def run_summary(results: DataFrame) -> DataFrame:
    """(metric, value) rows of a run."""
    bad = F.col("final_status") == "Abnormal"
    row = results.agg(
        F.count(F.lit(1)).cast("double").alias("Total_Result_Rows"),
        F.count_distinct("tag").cast("double").alias("Total_Tags"),
        F.count_distinct("ts").cast("double").alias("Total_Timestamps"),
        count_of(~bad).cast("double").alias("Normal_Rows"),
        count_of(bad).cast("double").alias("Abnormal_Rows"),
        (count_of(bad) / F.count(F.lit(1))).alias("Abnormal_Rate"),
        count_of(F.col("final_class") == "Drift").cast("double").alias("Drift_Count"),
        count_of(F.col("final_class") == "Drift + Anomaly").cast("double").alias("Drift_Anomaly_Count"),
        count_of(F.col("final_class") == "Strong Anomaly").cast("double").alias("Strong_Anomaly_Count"),
    )
    return row.unpivot([], row.columns, "metric", "value")


def compare(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Results beside labels on (ts, tag)."""
    own = results.select("ts", "tag", F.col("final_class").alias("own_class"), F.col("final_status").alias("own_status"))
    return own.join(labels.select("ts", "tag", "label_class", "label_binary"), ["ts", "tag"])


def confusion(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, TN, FP, FN and their rates, overall or per group; x / 0 is null."""
    own, label = F.col("own_status") == "Abnormal", F.col("label_binary") == "Abnormal"
    df = compared.groupBy(*by).agg(
        count_of(own & label).alias("tp"), count_of(~own & ~label).alias("tn"), count_of(own & ~label).alias("fp"), count_of(~own & label).alias("fn")
    )
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    return df.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "specificity": F.try_divide(tn, tn + fp),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "fpr": F.try_divide(fp, fp + tn),
            "fnr": F.try_divide(fn, fn + tp),
        }
    )


def match_by_timestamp(compared: DataFrame) -> DataFrame:
    same = F.col("own_status") == F.col("label_binary")
    return compared.groupBy("ts").agg(
        F.count(F.lit(1)).alias("compared"), count_of(same).alias("matches"), (count_of(same) / F.count(F.lit(1))).alias("match_rate")
    )


def crosstab_margins(compared: DataFrame, rows: str = "label_class", cols: str = "own_class") -> DataFrame:
    """Counts of label × own class with totals, as rows (``All`` marks a total)."""
    cube = compared.cube(rows, cols).agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("_gr"), F.grouping(cols).alias("_gc"))
    return cube.select(
        F.when(F.col("_gr") == 1, "All").otherwise(F.col(rows)).alias(rows),
        F.when(F.col("_gc") == 1, "All").otherwise(F.col(cols)).alias(cols),
        "n",
    )


def class_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: readings compared, changed rows and tags, change rate."""
    both = new.select("ts", "tag", F.col("final_class").alias("a")).join(
        old.select("ts", "tag", F.col("final_class").alias("b")), ["ts", "tag"]
    )
    changed = F.col("a") != F.col("b")
    return both.agg(
        F.count(F.lit(1)).alias("compared"),
        count_of(changed).alias("changed_rows"),
        F.count_distinct(F.when(changed, F.col("tag"))).alias("changed_tags"),
        (count_of(changed) / F.count(F.lit(1))).alias("changed_rate"),
    )


def day_tag_scores(results: DataFrame) -> DataFrame:
    """Per day and tag: abnormal count + 1e-6·Σ|z|, ranked inside the day."""
    bad = results.where("final_status = 'Abnormal'").withColumn("day", F.to_date("ts"))
    df = bad.groupBy("day", "tag").agg((F.count(F.lit(1)) + 1e-6 * F.sum("abs_z")).alias("drift_score"))
    order = Window.partitionBy("day").orderBy(F.desc("drift_score"), "tag")
    return df.withColumn("rank_order", F.row_number().over(order))


def strong_by_day(results: DataFrame) -> DataFrame:
    """Strong anomalies per day and tag, ranked inside the day."""
    strong = results.where("final_class = 'Strong Anomaly'").withColumn("day", F.to_date("ts"))
    df = strong.groupBy("day", "tag").agg(F.count(F.lit(1)).alias("strong_count"))
    order = Window.partitionBy("day").orderBy(F.desc("strong_count"), "tag")
    return df.withColumn("rank_order", F.row_number().over(order))


def points_summary(points: DataFrame) -> DataFrame:
    """Per tag: outlier, process and combined counts."""
    s = F.col("status")
    return points.groupBy("tag").agg(
        count_of(s == "Outlier Only").alias("outlier_only"),
        count_of(s == "Process Issue Only").alias("process_only"),
        count_of(s == "Both").alias("both"),
        F.count(F.lit(1)).alias("total"),
        F.max("outlier_score").alias("max_outlier_score"),
    )


def data_quality(results: DataFrame) -> DataFrame:
    """Flagged share in %, quality and health band."""
    flagged = F.round(100.0 * count_of(F.col("final_status") == "Abnormal") / F.count(F.lit(1)), 2)
    df = results.agg(flagged.alias("flagged_pct"))
    p = F.col("flagged_pct")
    return df.select(p, (100 - p).alias("quality_pct"), F.when(p < 20, "Healthy").when(p <= 30, "Watch").otherwise("Critical").alias("health"))


def tag_analysis(summary: DataFrame, peers: DataFrame, drift: DataFrame) -> DataFrame:
    """Per tag: worst status, drift score, anomaly count and first four peers."""
    listed = peers.where(F.col("rank") <= 4).groupBy(F.col("target").alias("tag")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "peer"))), lambda s: s["peer"]), ", ").alias("peers")
    )
    status = (
        F.when(F.col("strong_anomaly_count") > 0, "Strong Anomaly").when(F.col("drift_anomaly_count") > 0, "Drift + Anomaly").when(F.col("drift_count") > 0, "Drift").otherwise("Normal")
    )
    df = summary.withColumn("status", status).join(drift.select("tag", "drift_score"), "tag", "left").join(listed, "tag", "left")
    return df.select("tag", "status", "drift_score", F.col("abnormal_count").alias("anomaly_count"), "peers")


def tag_insights(results: DataFrame, reason: str = "reason", most: int = 5) -> DataFrame:
    """Per tag: flagged readings and its first distinct reasons in time order."""
    bad = results.where("final_status = 'Abnormal'")
    first = bad.groupBy("tag", reason).agg(F.min("ts").alias("_t"))
    order = Window.partitionBy("tag").orderBy("_t", reason)
    top = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    texts = top.groupBy("tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(reason).alias("t")))), lambda s: s["t"]).alias("reasons"))
    return bad.groupBy("tag").agg(F.count(F.lit(1)).alias("flagged")).join(texts, "tag")


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; the limit reaches the tasks before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_best_duplicate(df: DataFrame) -> DataFrame:
    """One row per (ts, tag): the primary cluster's, then the most severe."""
    return top_n_per_group(df, ["ts", "tag"], [F.desc("is_primary"), F.desc("severity"), F.col("cluster_id")], 1)


def latest_by(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r")).select(*keys, "_r.*")


def page(df: DataFrame, order: Sequence[Column], size: int, number: int, most: int = 500) -> DataFrame:
    """One page of an ordered listing of ``size`` rows, from 1 to ``most``."""
    if not 1 <= size <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def month_pages(results: DataFrame) -> DataFrame:
    """Per tag and month: readings and abnormal readings."""
    return results.groupBy("tag", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), count_of(F.col("final_status") == "Abnormal").alias("abnormal")
    )


def sample_rows(series: Series, cap: int, seed: int = 42) -> DataFrame:
    """A repeatable random subset of ``cap`` rows per tag, in time order."""
    w = Window.partitionBy("tag").orderBy(F.xxhash64("ts", "row_index", F.lit(seed)), "ts", "row_index")
    return series.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def fill_calendar(counts: DataFrame, days: int = 14) -> DataFrame:
    """The last ``days`` days up to the newest one, with 0 where nothing was counted."""
    last = counts.agg(F.max("day").alias("last"))
    cal = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return cal.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def periods(series: Series, flagged: DataFrame, severity: str = "abs_z", gap_days: int = 1) -> DataFrame:
    """Flagged readings of a tag merged while the gap stays under two whole days."""

    def starts(w: WindowSpec) -> dict[str, Column]:
        gap = F.floor((micros("ts") - micros(F.lag("ts").over(w))) / F.lit(86_400_000_000))
        return {"_new": F.when(gap <= gap_days, 0).otherwise(1)}

    lane = series.lane(flagged).rolling(1, 0, starts)
    df = lane.running({"_pid": ("sum", "_new")}).done()
    return df.groupBy("tag", F.col("_pid").alias("period_id")).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("points"),
        F.max(severity).alias("max_severity"),
        F.avg(severity).alias("avg_severity"),
        F.min_by("final_class", F.struct("ts", "row_index")).alias("first_class"),
    )
