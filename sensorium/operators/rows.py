"""Row filters and label clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions.scalar import any_of, to_number, yes
from sensorium.plans.attach import beside
from sensorium.series import Series

# Class texts read as Normal.
NORMAL_WORDS = ("normal", "ok", "good")


def filter_date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends inclusive."""
    return df.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def lookback_months(df: DataFrame, months: int) -> DataFrame:
    """Readings of the last ``months`` before the newest one."""
    last = df.agg(F.max("ts").alias("_last"))
    start = F.col("_last") - F.make_ym_interval(F.lit(0), F.lit(months))
    return beside(df, last).where(F.col("ts") >= start).drop("_last")


def filter_duration(df: DataFrame, span: str = "6m", custom_months: int | None = None) -> DataFrame:
    """full, 3m, 6m, 1y or custom months back from the newest reading."""
    months = {"3m": 3, "6m": 6, "1y": 12, "custom": custom_months}.get(span)
    return df if months is None else lookback_months(df, months)


def filter_through_day(df: DataFrame, day: str) -> DataFrame:
    """Everything up to the end of the day."""
    return df.where(F.col("ts") < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz"))


def filter_day(df: DataFrame, day: str) -> DataFrame:
    start = F.lit(day).cast("date")
    return df.where((F.col("ts") >= start.cast("timestamp_ntz")) & (F.col("ts") < F.date_add(start, 1).cast("timestamp_ntz")))


def _matches(c: Column, op: str, value: object, upper: object = None) -> Column:
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = None
    x = to_number(c) if number is not None else c.cast("string")
    v = F.lit(number if number is not None else str(value))
    if op == "between":
        return x.between(v, F.lit(float(upper)))
    if op in ("==", "!="):
        same = (F.abs(x - v) <= 1e-8 + 1e-5 * abs(number)) if number is not None else x == v
        return same if op == "==" else ~same
    return {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]


def drop_rows_where(wide: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Drop a row when any rule holds; a missing reading keeps the row.

    A rule is ``{status_tag, operator, value[, upper]}``; ``between`` takes ``upper``.
    """
    use = [r for r in rules if r["status_tag"] in wide.columns]
    hits = [_matches(F.col(r["status_tag"]), r["operator"], r["value"], r.get("upper")) for r in use]
    return wide.where(~any_of(hits)) if hits else wide


def drop_shutdown_rows(series: Series, indicators: Sequence[str], limit: float = 1e-6) -> Series:
    """Drop timestamps at which an indicator tag is at or below the limit."""
    off = series.df.where(F.col("tag").isin(*indicators) & (F.col("value") <= limit)).select("ts").distinct()
    return series.pipe(lambda d: d.join(off, "ts", "left_anti"))


def drop_empty(wide: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows without any tag value go, then tags without any value."""
    row = wide.agg(*[F.count(t).alias(t) for t in tags]).first()
    kept = [t for t in tags if row[t]]
    return wide.dropna("all", subset=kept).drop(*[t for t in tags if t not in kept])


def drop_constant_tags(series: Series, floor: float = 1e-12) -> Series:
    spread = series.df.groupBy("tag").agg(F.stddev_samp("value").alias("s")).where(F.col("s") >= floor)
    return series.pipe(lambda d: d.join(spread.select("tag"), "tag", "left_semi"))


def keep_critical_tags(summary: DataFrame, critical: Sequence[str], counts: Sequence[str], readings: DataFrame | None = None) -> DataFrame:
    """Only the critical tags, with zero rows for quiet ones; everything when none matches.

    A critical tag matches if ``readings`` has it, be it quiet or not; without ``readings``, if ``summary`` has it.
    """
    wanted = summary.sparkSession.createDataFrame([(t,) for t in critical], "tag string")
    known = summary if readings is None else readings
    if not known.join(F.broadcast(wanted), "tag", "left_semi").limit(1).count():
        return summary
    return wanted.join(summary, "tag", "left").fillna(0, list(counts))


def median_fill(series: Series, target: str, need: int = 30) -> DataFrame:
    """Readings at the target's timestamps; missing ones take the tag median (0 if it has none)."""
    times = series.df.where((F.col("tag") == target) & F.col("value").isNotNull()).select("ts").distinct()
    enough = times.limit(need).count() >= need
    tags = series.df.select("tag").distinct()
    grid = times.where(F.lit(enough)).join(F.broadcast(tags))
    df = grid.join(series.df.select("ts", "tag", "value"), ["ts", "tag"], "left")
    mids = series.quantiles({"_m": ("value", 0.5)}, df.select("tag", "value"))
    return series.attach(mids, df).select("ts", "tag", F.coalesce("value", "_m", F.lit(0.0)).alias("value"))


def standardize_labels(df: DataFrame, ts: str, tag: str, cls: str, cluster: bool = False) -> DataFrame:
    """Label rows as ``ts, tag, label_class, label_binary``."""
    text = F.trim(F.col(cls))
    low = F.lower(text)
    normal = low.isin(*NORMAL_WORDS)
    if cluster:
        normal = normal | low.contains("cluster drift") | low.contains("supported")
    unknown = low.isNull() | low.isin("", "unknown", "nan", "none")
    binary = F.when(unknown, "Unknown").when(normal, "Normal").otherwise("Abnormal")
    return df.select(
        F.col(ts).alias("ts"), F.trim(F.col(tag).cast("string")).alias("tag"), F.when(yes(normal), "Normal").otherwise(text).alias("label_class"), binary.alias("label_binary")
    )


def normalize_day(c: Column | str) -> Column:
    """ISO or month/day/year text (day first when the month is impossible) as a date."""
    x = F.trim(F.col(c) if isinstance(c, str) else c)
    forms = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d/M/yyyy")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in forms])


def points_for_tab(points: DataFrame, tab: str) -> DataFrame:
    """Point rows of the outlier, process or both tab by issue category."""
    wanted = {"outlier": ("tag", "both"), "process": ("process", "both"), "both": ("tag", "process", "both")}[tab]
    return points.where(F.col("issue_category").isin(*wanted))
