"""Between wide tag matrices and long readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.functions.scalar import to_number
from sensorium.session import small_rows


def to_observations(wide: DataFrame, tags: Sequence[str], ts: str = "ts", extra: Sequence[str] = ()) -> DataFrame:
    """One row per (ts, tag); missing readings stay as null values."""
    return wide.unpivot([ts, *extra], list(tags), "tag", "value")


def to_long(df: DataFrame, ts: str, tags: Sequence[str] | None = None, tag: str | None = None, value: str | None = None) -> DataFrame:
    """Clean long readings from a wide or long table; rows without ts, tag or value go."""
    if tag and value:
        long = df.select(F.col(ts).alias("ts"), F.col(tag).alias("tag"), F.col(value).alias("value"))
    else:
        long = to_observations(df.select(F.col(ts).alias("ts"), *tags), tags)
    long = long.select("ts", F.trim(F.col("tag").cast("string")).alias("tag"), to_number("value").alias("value"))
    return long.where(
        F.col("ts").isNotNull()
        & F.col("tag").isNotNull()
        & F.col("value").isNotNull()
        & (F.lower("tag") != "nan")
    )


def tag_list(df: DataFrame) -> list[str]:
    """The tag names, needed on the driver only to name the columns of a wide table."""
    limit = min(small_rows(df.sparkSession), 5000)
    rows = df.select("tag").distinct().orderBy("tag").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many tags for a wide table; stay with long readings")
    return [r["tag"] for r in rows]


def pivot_mean(long: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Wide matrix; duplicate readings are averaged, tags without any value are left out."""
    tags = tag_list(long.where(F.col("value").isNotNull())) if tags is None else list(tags)
    return long.groupBy("ts").pivot("tag", tags).agg(F.avg("value"))


def pivot_first(observations: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Wide matrix by row number: first non-null value per cell, ts is the row's earliest."""
    cells = [
        F.first(F.when(F.col("tag") == t, F.col("value")), ignorenulls=True).alias(t) for t in tags
    ]
    return observations.groupBy("row_index").agg(F.min("observed_at").alias("ts"), *cells)


def observations_to_wide(observations: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Wide matrix by (row number, ts): the latest stored value of a cell wins."""
    cells = [
        F.max_by("value", F.when((F.col("tag") == t), F.col("seq"))).alias(t) for t in tags
    ]
    return observations.groupBy("row_index", "observed_at").agg(*cells)


def load_wide_before(observations: DataFrame, dataset_id: int, end: object, tags: Sequence[str]) -> DataFrame:
    """Readings of one dataset before ``end`` (exclusive) as a wide matrix."""
    kept = observations.where(
        (F.col("dataset_id") == dataset_id)
        & F.col("observed_at").isNotNull()
        & (F.col("observed_at") < F.lit(end).cast("timestamp_ntz"))
    )
    return pivot_first(kept, tags)
