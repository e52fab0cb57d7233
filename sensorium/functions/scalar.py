"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, or null for text, NaN and infinities."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def yes(flag: Column) -> Column:
    """A flag with null read as false."""
    return F.coalesce(flag, F.lit(False))


def one(flag: Column) -> Column:
    """1 when the flag holds, else 0 (also for null)."""
    return F.when(flag, 1).otherwise(0)


def count_of(flag: Column) -> Column:
    return F.coalesce(F.sum(one(flag)), F.lit(0)).cast("long")


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bound a value; null stays null."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def clip_num(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Bound a value; null, NaN and infinities become ``low``."""
    return F.coalesce(clip(to_number(c), low, high), F.lit(float(low)))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is null or zero."""
    return F.when(col(b) != 0, col(a) / col(b))


def signed_abs_z(z_std: Column | str, z_robust: Column | str) -> Column:
    """Sign of the standard z (else of the robust z) with the larger magnitude."""
    a, b = col(z_std), col(z_robust)
    sign = F.when(a != 0, F.signum(a)).otherwise(F.signum(b))
    return sign * F.greatest(F.abs(a), F.abs(b))


def blend_z(z_std: Column | str, z_robust: Column | str, w_std: float = 0.55, w_robust: float = 0.45, cap: float = 20.0) -> Column:
    """Weighted mean of two z values, clipped."""
    return clip(col(z_std) * w_std + col(z_robust) * w_robust, -cap, cap)


def weighted_avg(values: Column | str, weights: Column | str) -> Column:
    """Aggregate: mean over rows whose weight is positive and value present."""
    v, w = col(values), to_number(weights)
    use = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(use, v * w)), F.sum(F.when(use, w)))


def weighted_median(values: Column, weights: Column) -> Column:
    """First value, in value order, at which half of the weight is reached.

    Takes two arrays of equal length, bounded by the peers of one reading.
    """
    pairs = F.filter(
        F.arrays_zip(values.alias("v"), weights.alias("w")),
        lambda p: p["v"].isNotNull() & (p["w"] > 0),
    )
    pairs = F.array_sort(pairs)
    half = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"]) / 2
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, p: Column) -> Column:
        total = acc["cum"] + p["w"]
        hit = acc["at"].isNull() & (total >= half)
        return F.struct(total.alias("cum"), F.when(hit, p["v"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(pairs, start, step)["at"]


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [yes(f) for f in flags], F.lit(False))


# Texts for the position of a value in its reference percentiles.
RANGE_TEXTS = {
    "below_outer": "Below 1pct outer baseline",
    "below_soft": "Below 5pct soft baseline",
    "inside": "Inside 5-95 baseline",
    "above_soft": "Above 95pct soft baseline",
    "above_outer": "Above 99pct outer baseline",
}


def range_position(x: Column, p1: Column, p5: Column, p95: Column, p99: Column) -> Column:
    """Where a value lies in the reference percentiles."""
    t = RANGE_TEXTS
    return (
        F.when(x.isNull(), "Unknown")
        .when(x < p1, t["below_outer"])
        .when(x < p5, t["below_soft"])
        .when(x <= p95, t["inside"])
        .when(x <= p99, t["above_soft"])
        .otherwise(t["above_outer"])
    )


def severity_band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 4.0, "High").when(s >= 2.5, "Medium").otherwise("Low")


def fixed(c: Column | str, digits: int) -> Column:
    """Plain fixed-point text without thousands separators."""
    return F.format_string(f"%.{digits}f", col(c))


def date_text(c: Column | str, with_time: bool = False) -> Column:
    """Month/day/year without leading zeros, optionally with the time."""
    return F.date_format(col(c), "M/d/yyyy HH:mm:ss" if with_time else "M/d/yyyy")


def minute_text(c: Column | str) -> Column:
    return F.date_format(col(c), "MM/dd/yyyy HH:mm")


def drift_lead_score(first: Column, then: Column, span_days: float = 20.0) -> Column:
    """1 - gap/20 when ``first`` is before ``then``, never below 0."""
    gap = F.floor((micros(then) - micros(first)) / F.lit(86_400_000_000))
    return F.when(first < then, F.greatest(F.lit(0.0), 1 - gap / span_days)).otherwise(F.lit(0.0))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch (zone-less timestamps are read in the session zone, UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))
