"""Robust location and scale per tag, z values, trims and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.plans.attach import attach
from sensorium.plans.quantiles import quantiles
from sensorium.series import Series
from sensorium.session import settle

# Consistency factors of the MAD and the IQR for a normal law.
MAD_K = 1.4826
IQR_K = 1.349


def center_mad(
    series: Series,
    columns: dict[str, str],
    df: DataFrame | None = None,
    probs: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Per tag, for each ``prefix: column``: n, mean, std (ddof 1 and 0), median and raw MAD.

    Two passes whatever the number of columns: medians and quantiles first, then the
    median of the absolute deviations. ``probs`` asks for extra quantiles on the way.
    """
    df = series.df if df is None else df
    wanted = {f"{p}_center": (c, 0.5) for p, c in columns.items()} | (probs or {})
    moments = [
        piece
        for p, c in columns.items()
        for piece in (
            F.count(c).alias(f"{p}_n"),
            F.avg(c).alias(f"{p}_mean"),
            F.stddev_samp(c).alias(f"{p}_std"),
            F.stddev_pop(c).alias(f"{p}_std0"),
        )
    ]
    first = settle(series.quantiles(wanted, df, moments))
    slim = df.select("tag", *dict.fromkeys(columns.values()))
    joined = attach(slim, first.select("tag", *[f"{p}_center" for p in columns]), "tag", series.tags)
    devs = joined.select(
        "tag", *[F.abs(F.col(c) - F.col(f"{p}_center")).alias(f"_d_{p}") for p, c in columns.items()]
    )
    mads = series.quantiles({f"{p}_mad": (f"_d_{p}", 0.5) for p in columns}, devs)
    return first.join(mads, "tag")


def scale_of(prefix: str, policy: str = "std1", eps: float = 1e-9, iqr: Column | None = None) -> Column:
    """Scale from the columns of ``center_mad``.

    floor  1.4826·MAD, or eps when the MAD is 0
    std1   1.4826·MAD, else std (ddof 1), else eps
    std0   1.4826·MAD, else std (ddof 0), else eps
    unit   1.4826·MAD, else std (ddof 1), else 1
    ladder 1.4826·MAD, else std (ddof 1), else IQR/1.349, else eps
    zero   1.4826·MAD, null when the MAD is 0 (z becomes 0)
    """
    mad = MAD_K * F.col(f"{prefix}_mad")
    std = F.col(f"{prefix}_std0" if policy == "std0" else f"{prefix}_std")
    present = F.col(f"{prefix}_n") > 0
    if policy == "zero":
        return F.when(mad > 0, mad)
    if policy == "floor":
        return F.when(present, F.when(mad > 0, mad).otherwise(F.lit(eps)))
    if policy == "ladder":
        tail = F.when(iqr / IQR_K > eps, iqr / IQR_K) if iqr is not None else F.lit(None)
        chain = F.coalesce(F.when(mad > eps, mad), F.when(std > eps, std), tail, F.lit(eps))
    else:
        last = F.lit(1.0) if policy == "unit" else F.lit(eps)
        chain = F.coalesce(F.when(mad >= eps, mad), F.when(std >= eps, std), last)
    return F.when(present, chain)


POLICIES = ("floor", "std1", "std0", "unit", "ladder", "zero", "nan_poison")


def robust_scale(series: Series, policy: str = "std1", eps: float = 1e-9, column: str = "value") -> DataFrame:
    """Center and scale per tag under one of the named fallbacks.

    ``nan_poison`` makes both null for a tag with any missing reading, and falls back
    to the std, then to 1, when the MAD is 0.
    """
    probs = {"q25": (column, 0.25), "q75": (column, 0.75)} if policy == "ladder" else None
    table = center_mad(series, {"v": column}, probs=probs)
    if policy == "nan_poison":
        holes = series.df.groupBy("tag").agg(F.count_if(F.col(column).isNull()).alias("holes"))
        std = F.when(F.col("v_std") > 0, F.col("v_std")).otherwise(1.0)
        scale = F.when(F.col("v_mad") == 0, std).otherwise(MAD_K * F.col("v_mad"))
        table = table.join(holes, "tag").withColumn("scale", F.when(F.col("holes") == 0, scale))
    else:
        iqr = (F.col("q75") - F.col("q25")) if policy == "ladder" else None
        table = table.withColumn("scale", scale_of("v", policy, eps, iqr))
    return table.select("tag", F.col("v_n").alias("n"), F.col("v_center").alias("center"), "scale")


def robust_z(series: Series, policy: str = "std1", eps: float = 1e-9, reference: Series | None = None) -> DataFrame:
    """Readings with their robust z; center and scale from ``reference`` when given."""
    limits = robust_scale(reference or series, policy, eps)
    z = (F.col("value") - F.col("center")) / F.col("scale")
    if policy == "zero":
        z = F.when(F.col("value").isNotNull(), F.coalesce(z, F.lit(0.0)))
    return series.attach(limits).withColumn("z", z)


def inner_trim(
    series: Series,
    tail: float,
    min_inner: Column | int,
    column: str = "value",
    df: DataFrame | None = None,
    name: str = "inner",
) -> DataFrame:
    """Add ``name``: the value when it lies between the tail quantiles of its tag.

    Tags with fewer than 10 values, or with fewer than ``min_inner`` left, keep all.
    """
    df = series.df if df is None else df
    if tail <= 0:
        return df.withColumn(name, F.col(column))
    bounds = series.quantiles({"_lo": (column, tail), "_hi": (column, 1 - tail)}, df)
    marked = series.attach(bounds, df).withColumn("_in", F.col(column).between(F.col("_lo"), F.col("_hi")))
    sizes = marked.groupBy("tag").agg(
        F.count(column).alias("_n"), F.count_if(F.col("_in")).alias("_kept")
    )
    floor = F.lit(min_inner) if isinstance(min_inner, int) else min_inner
    sizes = sizes.withColumn("_trim", (F.col("_n") >= 10) & (F.col("_kept") >= floor)).drop("_n", "_kept")
    marked = series.attach(sizes, marked)
    keep = F.when(~F.col("_trim") | F.col("_in"), F.col(column))
    return marked.withColumn(name, keep).drop("_lo", "_hi", "_in", "_trim")


def reference_profile(series: Series, clean: DataFrame, scale_rule: str = "none") -> DataFrame:
    """Per tag mean, std, median, MAD, min, max and tail percentiles of the clean readings.

    ``scale_rule``: none, ``min`` (min(std, 1.35·MAD)) or ``clamp``
    (std between 0.75·MAD and 1.35·max(MAD, IQR), with population std).
    """
    probs = {n: ("value", p) for n, p in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))}
    table = center_mad(series, {"v": "value"}, clean, probs)
    edges = clean.groupBy("tag").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    table = table.join(edges, "tag")
    eps = 1e-9
    mad = scale_of("v", "std0" if scale_rule == "clamp" else "std1", eps)
    std = F.col("v_std0") if scale_rule == "clamp" else F.col("v_std")
    std = F.when(std >= eps, std).otherwise(mad)
    if scale_rule == "min":
        effective = F.least(std, 1.35 * mad)
    elif scale_rule == "clamp":
        iqr = (F.col("p75") - F.col("p25")) / IQR_K
        effective = F.greatest(F.least(std, 1.35 * F.greatest(mad, iqr)), 0.75 * mad)
    else:
        effective = std
    return table.select(
        "tag",
        F.col("v_n").alias("n"),
        F.col("v_mean").alias("mean"),
        std.alias("std"),
        F.col("v_center").alias("median"),
        mad.alias("mad_scale"),
        "min",
        "max",
        "p01",
        "p05",
        "p95",
        "p99",
        F.greatest(effective, F.lit(eps)).alias("effective_scale"),
    )


def global_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles over all rows as a one-row table."""
    return quantiles(df, [], wanted)


def names(df: DataFrame, skip: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in skip]
