"""Reading tables of unknown layout: headers, timestamp column, tag columns, timestamps as text or numbers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.functions.scalar import col, to_number
from sensorium.series import Series
from sensorium.sources.wide import to_long

# Column name hints.
TIMESTAMP_HINTS = ("timestamp", "time_stamp", "datetime", "date_time", "time", "date")
TAG_HINTS = ("tag", "tags", "variable", "parameter", "sensor", "feature", "column", "point")
VALUE_HINTS = ("actual_value", "actual", "value", "reading", "measured_value", "measurement", "pv", "process_value")
IGNORED_HINTS = (
    "final_class", "final_status", "status", "class", "predicted", "prediction", "residual", "zscore", "z_score", "lower", "upper", "limit", "threshold",
    "direction", "is_outlier", "outlier", "anomaly", "drift", "score", "clean", "flag", "remarks", "comment", "reason",
)
# Accepted text forms of a timestamp, month first.
TEXT_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
)


def read_series(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """CSV (all text) or Parquet by suffix; a row cap only on request."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".txt")):
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df if max_rows is None else df.limit(max_rows)


def normalize_headers(df: DataFrame, stem: str = "Column") -> DataFrame:
    """Trimmed names; blank ones get a numbered name, and a name that came before the count of its earlier uses."""

    def named(place: int, name: str | None) -> str:
        text = (name or "").strip()
        return f"{stem}_{place}" if text.lower() in ("", "nan", f"_c{place}") else text

    names = [named(*x) for x in enumerate(df.columns)]
    return df.toDF(*[f"{x}_{k}" if (k := names[:i].count(x)) else x for i, x in enumerate(names)])


def resolve_column(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """First wanted name found without regard to case, then with runs of other signs read as underscores."""
    plain = {c.strip().lower(): c for c in columns}
    for name in wanted:
        if name.lower() in plain:
            return plain[name.lower()]
    folded = {re.sub(r"[^a-z0-9]+", "_", c.strip().lower()): c for c in columns}
    for name in wanted:
        key = re.sub(r"[^a-z0-9]+", "_", name.lower())
        if key in folded:
            return folded[key]
    return None


def parse_timestamp(c: Column | str) -> Column:
    """Timestamp from text (month first) or from a number: serial day, epoch seconds or epoch milliseconds."""
    x = col(c)
    text = F.trim(x.cast("string"))
    number = text.try_cast("double")
    day_zero = F.lit("1899-12-30").cast("timestamp_ntz")
    whole = F.floor(number)
    part = F.round((number - whole) * 86400, 3).cast("decimal(18,6)")
    offset = F.make_dt_interval(days=whole.cast("int"), secs=part)
    serial = F.when(number.between(2e4, 8e4), day_zero + offset)
    seconds = F.when(number.between(1e9, 2e10), F.timestamp_seconds(number).cast("timestamp_ntz"))
    millis = F.when(number.between(1e12, 2e13), F.timestamp_millis(number.cast("long")).cast("timestamp_ntz"))
    parsed = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TEXT_FORMATS]
    return F.when(number.isNotNull(), F.coalesce(serial, seconds, millis)).otherwise(F.coalesce(*parsed))


def validate_timestamps(df: DataFrame, ts: str) -> DataFrame:
    """One row: how many timestamps can be read and how many cannot."""
    good = parse_timestamp(ts).isNotNull()
    return df.agg(F.count_if(good).alias("parseable"), F.count_if(~good).alias("bad"))


def plain_name(name: str) -> str:
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def detect_timestamp_col(df: DataFrame) -> str:
    """Column that looks most like a time: name score + 5·parse ratio + 2·unique ratio over all rows."""
    kinds = dict(df.dtypes)
    times = [F.col(f"`{c}`") if kinds[c] in ("timestamp", "timestamp_ntz", "date") else parse_timestamp(f"`{c}`") for c in df.columns]
    counts = [x for i, c in enumerate(df.columns) for x in (F.count(f"`{c}`").alias(f"n{i}"), F.count(times[i]).alias(f"p{i}"))]
    row = df.agg(*counts).first().asDict()
    # only columns that hold any time are counted exactly
    some = [i for i in range(len(times)) if row[f"p{i}"]]
    if some:
        row |= df.agg(*[F.count_distinct(times[i]).alias(f"u{i}") for i in some]).first().asDict()

    def score(i: int) -> float:
        name, n = plain_name(df.columns[i]), row[f"n{i}"]
        known = 5.0 if name in TIMESTAMP_HINTS else 3.0 if any(h in name for h in TIMESTAMP_HINTS) else 0.0
        return known + (5.0 * row[f"p{i}"] / n + 2.0 * min(row.get(f"u{i}", 0) / n, 1.0) if n else 0.0)

    best = max(range(len(df.columns)), key=score)
    if score(best) < 3.0:
        raise ValueError("no column looks like a timestamp; name one")
    return df.columns[best]


def detect_tag_cols(df: DataFrame, ts: str, min_obs: int = 5, min_share: float = 0.2) -> list[str]:
    """Columns with enough numeric values, from one aggregate over the table."""
    names = [c for c in df.columns if c != ts and not any(h in plain_name(c) for h in IGNORED_HINTS)]
    if not names:
        return []
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(to_number(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)]
    ).first()
    total = max(row["n"], 1)
    return [c for i, c in enumerate(names) if row[f"v{i}"] >= min_obs and row[f"v{i}"] / total >= min_share]


def detect_layout(df: DataFrame, ts: str) -> tuple[str, str | None, str | None]:
    """``("wide", None, None)`` or ``("long", tag column, value column)``."""
    if len(detect_tag_cols(df, ts)) >= 8:
        return "wide", None, None
    names = [c for c in df.columns if c != ts]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        aggs += [F.approx_count_distinct(x).alias(f"u{i}"), F.count(x).alias(f"c{i}"), F.count(to_number(x)).alias(f"v{i}"), F.approx_count_distinct(to_number(x)).alias(f"w{i}")]
    row = df.agg(*aggs).first()
    total = max(row["n"], 1)

    def named(c: str, hints: Sequence[str]) -> tuple[float, bool]:
        found = any(h in plain_name(c) for h in hints)
        return 4.0 * (plain_name(c) in hints) + 2.0 * found, found

    # one table of the pairs that may be (tag, value), best first
    pairs = []
    for i, tag in enumerate(names):
        tag_score, tag_named = named(tag, TAG_HINTS)
        tag_score += (row[f"v{i}"] != row[f"c{i}"]) + min(row[f"u{i}"] / 20.0, 2.0) + row[f"c{i}"] / total
        for j, value in enumerate(names):
            value_score, value_named = named(value, VALUE_HINTS)
            value_score += row[f"v{j}"] / total + min(row[f"w{j}"] / 20.0, 1.0)
            repeated = row[f"u{i}"] < max(total * 0.5, 20)
            if i != j and value_score >= 1.2 and (tag_named or value_named or repeated):
                pairs.append((-tag_score, i, -value_score, j))
    if not pairs:
        return "wide", None, None
    _, i, _, j = min(pairs)
    return "long", names[i], names[j]


def load_series(df: DataFrame, ts: str | None = None, min_obs: int = 10) -> Series:
    """Any table to clean long readings; duplicates averaged, tags with few readings left out."""
    df = normalize_headers(df)
    ts = ts or detect_timestamp_col(df)
    layout, tag, value = detect_layout(df, ts)
    kind = dict(df.dtypes)[ts]
    parsed = F.col(f"`{ts}`").cast("timestamp_ntz") if kind.startswith("timestamp") else parse_timestamp(f"`{ts}`")
    df = df.withColumn(ts, parsed)
    long = to_long(df, ts, tag=tag, value=value) if layout == "long" else to_long(df, ts, tags=detect_tag_cols(df, ts))
    mean = long.groupBy("ts", "tag").agg(F.avg("value").alias("value"))
    keep = mean.groupBy("tag").agg(F.count("value").alias("n")).where(F.col("n") >= min_obs)
    return Series(mean.join(keep.select("tag"), "tag", "left_semi").select("ts", "tag", "value"))
