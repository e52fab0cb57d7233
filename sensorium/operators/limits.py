"""Per-tag limits learned from clean readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.functions.scalar import yes
from sensorium.operators.stats import IQR_K, MAD_K, center_mad, global_quantiles, scale_of
from sensorium.operators.windows import diff
from sensorium.plans.attach import beside
from sensorium.plans.lane import Lane
from sensorium.plans.quantiles import quantiles
from sensorium.series import Series
from sensorium.session import settle

EPS = 1e-9


def mark(readings: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Bring row columns (one per timestamp) to every reading."""
    return readings.join(settle(rows.select("ts", *columns)), "ts", "left")


def fences(limits: DataFrame, drift: Column, anomaly: Column, strong: Column) -> DataFrame:
    """Threshold z columns and the limits center ± z·scale."""
    limits = limits.withColumns({"drift_z": drift, "drift_anomaly_z": anomaly, "strong_anomaly_z": strong})
    out = {}
    for name in ("drift", "drift_anomaly", "strong_anomaly"):
        reach = F.col(f"{name}_z") * F.col("scale")
        out[f"{name}_lower_limit"] = F.col("center") - reach
        out[f"{name}_upper_limit"] = F.col("center") + reach
    return limits.withColumns(out)


def clean_limits(series: Series, rows: DataFrame, method: str = "std", min_points: int = 30) -> DataFrame:
    """Center and scale per tag from the clean rows, or from all rows where too few are clean."""
    eps = 1e-12
    df = mark(series.df, rows, "clean").withColumn("_c", F.when(yes(F.col("clean")), F.col("value")))
    counts = df.groupBy("tag").agg(
        F.count("_c").alias("clean_count"), F.min("_c").alias("clean_min"), F.max("_c").alias("clean_max")
    )
    counts = counts.withColumn("fallback_used", F.col("clean_count") < max(5, min_points // 3))
    df = series.attach(counts, df)
    df = df.withColumn("_b", F.when(F.col("fallback_used"), F.col("value")).otherwise(F.col("_c")))
    stats = center_mad(series, {"b": "_b"}, df, {"q25": ("_b", 0.25), "q75": ("_b", 0.75)})
    robust = scale_of("b", "ladder", eps, F.col("q75") - F.col("q25"))
    if method == "robust":
        center, scale = F.col("b_center"), robust
    else:
        center = F.col("b_mean")
        scale = F.when(F.col("b_std") > eps, F.col("b_std")).otherwise(robust)
    table = stats.where(F.col("b_n") > 0).select(
        "tag", center.alias("center"), scale.alias("scale"), F.col("b_n").alias("baseline_count")
    )
    return table.join(counts, "tag")


def auto_thresholds(series: Series, rows: DataFrame, limits: DataFrame) -> DataFrame:
    """One row of global z thresholds from the clean |z| distribution."""
    df = mark(series.attach(limits.select("tag", "center", "scale")), rows, "clean").where("clean")
    df = df.select(F.abs((F.col("value") - F.col("center")) / F.col("scale")).alias("_z"))
    q = global_quantiles(df, {"a": ("_z", 0.995), "b": ("_z", 0.999), "c": ("_z", 0.9995)})
    a = F.greatest(F.lit(3.0), "a")
    b = F.greatest(a + 0.5, "b")
    c = F.greatest(b + 1.0, "c")
    return q.select(
        F.round(a, 3).alias("drift_z"), F.round(b, 3).alias("drift_anomaly_z"), F.round(c, 3).alias("strong_anomaly_z")
    )


def adaptive_thresholds(series: Series, rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Limits with per-tag z thresholds; 3 / 3.5 / 5 for a tag without clean readings."""
    df = mark(series.attach(limits.select("tag", "center", "scale")), rows, "clean").where("clean")
    df = df.select("tag", F.abs((F.col("value") - F.col("center")) / F.col("scale")).alias("_z"))
    q = series.quantiles({"_a": ("_z", 0.995), "_b": ("_z", 0.999), "_c": ("_z", 0.9995)}, df)
    a = F.greatest(F.lit(2.4), "_a")
    b = F.greatest(a + 0.35, "_b")
    c = F.greatest(b + 0.6, "_c")
    has = F.col("_a").isNotNull()
    joined = limits.join(q, "tag", "left")
    return fences(
        joined,
        F.when(has, F.round(F.least(a, F.lit(12.0)), 4)).otherwise(3.0),
        F.when(has, F.round(F.least(b, F.lit(14.0)), 4)).otherwise(3.5),
        F.when(has, F.round(F.least(c, F.lit(16.0)), 4)).otherwise(5.0),
    ).drop("_a", "_b", "_c")


def hybrid_limits(series: Series, rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Scale becomes the widest of four estimates, center the mean of center and clean median."""
    clean = mark(series.df, rows, "clean").where("clean")
    stats = center_mad(series, {"y": "value"}, clean, {"_q1": ("value", 0.25), "_q3": ("value", 0.75)})
    std = F.coalesce("y_std", F.lit(0.0))
    mad = F.when(F.col("y_mad") < 1e-12, std).otherwise(MAD_K * F.col("y_mad"))
    iqr = F.col("_q3") - F.col("_q1")
    iqr = F.when(iqr > 1e-12, iqr / IQR_K).otherwise(0.0)
    wide = F.greatest(F.col("scale"), mad, iqr, std, F.lit(1e-9))
    enough = yes(F.col("y_n") >= 3)
    joined = limits.join(stats, "tag", "left")
    return joined.withColumns(
        {
            "center": F.when(enough, 0.5 * F.col("center") + 0.5 * F.col("y_center")).otherwise(F.col("center")),
            "scale": F.when(enough, wide).otherwise(F.col("scale")),
        }
    ).select(*limits.columns)


def widened(lower: Column, upper: Column, scale: Column, margin: float) -> tuple[Column, Column]:
    """Both limits moved outwards by a share of their distance."""
    width = F.when(upper - lower <= EPS, F.greatest(scale, F.lit(EPS))).otherwise(upper - lower)
    return lower - margin * width, upper + margin * width


def _core(series: Series, df: DataFrame, ref: str, z: float = 4.0, share: float = 0.60) -> DataFrame:
    """Add ``_k``: the reference value unless it is far out and enough others remain."""
    first = center_mad(series, {"r": ref}, df).select(
        "tag", F.col("r_center").alias("_rc"), scale_of("r", "std1", EPS).alias("_rs"), F.col("r_n").alias("_rn")
    )
    df = series.attach(first, df).withColumn(
        "_near", F.when(F.abs((F.col(ref) - F.col("_rc")) / F.col("_rs")) <= z, F.col(ref))
    )
    kept = df.groupBy("tag").agg(F.count("_near").alias("_nn"))
    df = series.attach(kept, df)
    enough = F.col("_nn") >= F.greatest(F.lit(10), F.floor(F.col("_rn") * F.lit(share)))
    return df.withColumn("_k", F.when(enough, F.col("_near")).otherwise(F.col(ref)))


def _final_band(series: Series, df: DataFrame, ref: str, k: float, margin: float, low: float, high: float) -> DataFrame:
    """Mean, median, std, scale and the widened limits of a reference population."""
    stats = center_mad(series, {"k": ref}, df, {"_ql": (ref, low), "_qh": (ref, high)})
    scale = scale_of("k", "std1", EPS)
    std = F.when(F.col("k_std") >= EPS, F.col("k_std")).otherwise(scale)
    lower = F.least(F.col("k_center") - k * scale, F.col("_ql"))
    upper = F.greatest(F.col("k_center") + k * scale, F.col("_qh"))
    lower, upper = widened(lower, upper, scale, margin)
    return stats.where(F.col("k_n") > 0).select(
        "tag",
        F.col("k_n").alias("reference_count"),
        F.col("k_mean").alias("reference_mean"),
        F.col("k_center").alias("reference_median"),
        std.alias("reference_std"),
        scale.alias("reference_scale"),
        lower.alias("lower_limit"),
        upper.alias("upper_limit"),
    )


def similar_history_limits(
    series: Series,
    rows: DataFrame,
    z: float = 2.5,
    relaxed: float = 3.5,
    buffer: float = 0.10,
    min_rows: int = 30,
    min_share: float = 0.05,
    k: float = 3.5,
    margin: float = 0.15,
) -> DataFrame:
    """Limits from all readings that resemble the clean window."""
    df = mark(series.df, rows, "clean").withColumn("_c", F.when(yes(F.col("clean")), F.col("value")))
    anchor = center_mad(
        series, {"c": "_c"}, df, {f"_q{p}": ("_c", p / 100) for p in (5, 25, 75, 95)}
    )
    scale = scale_of("c", "std1", EPS)
    iqr = F.col("_q75") - F.col("_q25")
    iqr = F.when(iqr >= EPS, iqr).otherwise(scale)
    reach = buffer * F.greatest(F.col("_q95") - F.col("_q5"), iqr, scale)
    anchor = anchor.where(F.col("c_n") > 0).select(
        "tag",
        F.col("c_n").alias("clean_count"),
        F.col("c_center").alias("clean_median"),
        scale.alias("clean_scale"),
        (F.col("_q5") - reach).alias("_low"),
        (F.col("_q95") + reach).alias("_high"),
    )
    df = series.attach(anchor, df, how="inner")
    far = F.abs((F.col("value") - F.col("clean_median")) / F.col("clean_scale"))
    band = F.col("value").between(F.col("_low"), F.col("_high"))
    df = df.withColumns({"_m1": yes((far <= z) | band), "_m2": yes((far <= max(z, relaxed)) | band)})
    counts = df.groupBy("tag").agg(
        F.count("value").alias("_full"), F.count_if("_m1").alias("_n1"), F.count_if("_m2").alias("_n2")
    )
    need = F.greatest(F.lit(min_rows), F.floor(F.col("_full") * F.lit(min_share)))
    counts = counts.withColumn("_relax", F.col("_n1") < need)
    counts = counts.withColumn("candidates", F.when(F.col("_relax"), F.col("_n2")).otherwise(F.col("_n1")))
    df = series.attach(counts, df)
    member = F.when(F.col("_relax"), F.col("_m2")).otherwise(F.col("_m1"))
    few = F.col("candidates") < max(5, min_rows // 2)
    df = df.withColumn("_r", F.when(few, F.col("_c")).otherwise(F.when(member, F.col("value"))))
    table = _final_band(series, _core(series, df, "_r"), "_k", k, margin, 0.005, 0.995)
    return table.join(anchor.select("tag", "clean_count", "clean_median", "clean_scale"), "tag")


def clean_window_limits(series: Series, rows: DataFrame, k: float = 3.5, margin: float = 0.15) -> DataFrame:
    """Limits from the clean window only."""
    df = mark(series.df, rows, "clean").withColumn("_r", F.when(yes(F.col("clean")), F.col("value")))
    return _final_band(series, _core(series, df, "_r"), "_k", k, margin, 0.005, 0.995)


def spike_free_limits(
    series: Series,
    features: DataFrame,
    rows: DataFrame,
    z: float = 2.75,
    other: float = 4.0,
    share: float = 0.60,
    min_rows: int = 30,
    k: float = 3.5,
    margin: float = 0.12,
) -> tuple[DataFrame, DataFrame]:
    """Limits from calm readings near the clean window, and the readings marked as reference."""
    cut = global_quantiles(rows, {"_cut": ("score", share)})
    flagged = beside(rows, cut).withColumn("_calm", F.col("score") <= F.col("_cut"))
    df = mark(features, flagged, "clean", "_calm").withColumn("_c", F.when(yes(F.col("clean")), F.col("value")))
    anchor = center_mad(series, {"c": "_c"}, df)
    anchor = anchor.where(F.col("c_n") > 0).select(
        "tag", F.col("c_n").alias("clean_count"), F.col("c_center").alias("_ac"), scale_of("c", "std1", EPS).alias("_as")
    )
    df = series.attach(anchor, df, how="inner")
    near = F.abs((F.col("value") - F.col("_ac")) / F.col("_as")) <= z
    quiet = (F.abs("spike_z") <= other) & (F.abs("change_z") <= other)
    member = yes(near & quiet & F.col("_calm")) | (yes(F.col("clean")) & F.col("value").isNotNull())
    df = df.withColumn("_m", member & F.col("value").isNotNull())
    counts = df.groupBy("tag").agg(F.count_if("_m").alias("_mn"))
    df = series.attach(counts, df)
    member = F.when(F.col("_mn") < min_rows, F.col("_c").isNotNull()).otherwise(F.col("_m"))
    df = df.withColumn("is_reference", member).withColumn("_r", F.when(F.col("is_reference"), F.col("value")))
    table = _final_band(series, df, "_r", k, margin, 0.01, 0.99).join(anchor.select("tag", "clean_count"), "tag")
    return table, df.select(*features.columns, "is_reference")


def clean_like_limits(
    series: Series,
    rows: DataFrame,
    z: float = 2.75,
    step: float = 4.0,
    min_rows: int = 30,
    k: float = 3.5,
    margin: float = 0.12,
) -> DataFrame:
    """Broad limits, central band and step scale from readings that behave like the clean period."""
    df = mark(settle(diff(series)), rows, "clean").withColumn("_c", F.when(yes(F.col("clean")), F.col("value")))
    counts = df.groupBy("tag").agg(F.count("_c").alias("_cn"))
    df = series.attach(counts, df)
    df = df.withColumn("_cv", F.when(F.col("_cn") < 5, F.col("value")).otherwise(F.col("_c")))
    base = center_mad(series, {"c": "_cv"}, df).select(
        "tag",
        F.col("c_n").alias("clean_count"),
        F.col("c_center").alias("clean_median"),
        scale_of("c", "std1", EPS).alias("clean_scale"),
    )
    # Steps between neighbours of the clean subset, whatever lies between them.
    picked = series.lane(df.where(F.col("clean"))).rolling(
        1, 0, lambda w: {"_step": F.col("value") - F.lag("value").over(w)}
    )
    steps = center_mad(series, {"d": "_step"}, picked.done()).select(
        "tag", F.col("d_center").alias("delta_center"), scale_of("d", "std1", EPS).alias("delta_scale")
    )
    df = series.attach(base, df)
    df = series.attach(steps, df)
    df = df.withColumn("_ae", F.abs(F.col("_cv") - F.col("clean_median")))
    errors = center_mad(series, {"e": "_ae"}, df).select(
        "tag", F.col("e_center").alias("abs_error_center"), scale_of("e", "std1", EPS).alias("abs_error_scale")
    )
    step_z = F.abs((F.coalesce("delta", F.lit(0.0)) - F.col("delta_center")) / F.col("delta_scale"))
    like = yes((F.abs((F.col("value") - F.col("clean_median")) / F.col("clean_scale")) <= z) & (step_z <= step))
    df = df.withColumn("_like", F.when(like, F.col("value")))
    sizes = df.groupBy("tag").agg(F.count("_like").alias("_ln"))
    df = series.attach(sizes, df)
    df = df.withColumn("_r", F.when(F.col("_ln") < min_rows, F.col("_cv")).otherwise(F.col("_like")))
    table = _final_band(series, df, "_r", k, margin, 0.01, 0.99)
    central = series.quantiles({"central_lower": ("_r", 0.05), "central_upper": ("_r", 0.95)}, df)
    return table.join(central, "tag").join(base, "tag").join(steps, "tag", "left").join(errors, "tag")


def value_bands(
    series: Series,
    rows: DataFrame,
    min_rows: int = 20,
    min_share: float = 0.06,
    most: int = 2,
    k: float = 3.0,
    margin: float = 0.10,
) -> DataFrame:
    """Up to ``most`` recurring value bands per tag, split at wide gaps between sorted stable values."""
    df = mark(series.df, rows, "stable").withColumn("_s", F.when(yes(F.col("stable")), F.col("value")))
    counts = df.groupBy("tag").agg(F.count("_s").alias("_sn"))
    tails = series.quantiles({"_q01": ("value", 0.01), "_q99": ("value", 0.99)}, df)
    df = series.attach(counts.join(tails, "tag"), df)
    middle = F.when(F.col("value").between(F.col("_q01"), F.col("_q99")), F.col("value"))
    df = df.withColumn("_v", F.when(F.col("_sn") < min_rows, middle).otherwise(F.col("_s")))
    values = df.where(F.col("_v").isNotNull()).groupBy("tag", F.col("_v").alias("value")).agg(F.count(F.lit(1)).alias("_w"))
    lane = Lane(values, ["tag"], ["value"], series.tag_rows)
    lane = lane.rolling(1, 0, lambda w: {"_gap": F.col("value") - F.lag("value").over(w)})
    gaps = quantiles(lane.done(), ["tag"], {"_g50": ("_gap", 0.5), "_g75": ("_gap", 0.75)}, series.tag_rows)
    totals = values.groupBy("tag").agg(F.sum("_w").alias("_total"))
    lane = lane.map(lambda d: series.attach(gaps.join(totals, "tag"), d))
    wide = F.col("_gap") > F.greatest(4.0 * F.col("_g50"), 2.0 * F.col("_g75"), F.lit(EPS))
    lane = lane.map(lambda d: d.withColumn("_cut", F.when((F.col("_total") >= min_rows) & yes(wide), 1).otherwise(0)))
    split = settle(lane.running({"_isle": ("sum", "_cut")}).done())
    isles = split.groupBy("tag", "_isle").agg(F.sum("_w").alias("_n"), F.max("_total").alias("_total"), F.min("value").alias("_first"))
    solo = F.col("_total") < min_rows
    isles = isles.withColumn("_keep", solo | (F.col("_n") >= min_rows) | (F.col("_n") / F.col("_total") >= min_share))
    order = Window.partitionBy("tag").orderBy(F.desc("_n"), "_first")
    ranked = (
        isles.where("_keep")
        .withColumn("band_id", F.row_number().over(order))
        .where(F.col("band_id") <= most)
        .select("tag", "_isle", "band_id")
    )
    whole = isles.groupBy("tag").agg(F.count_if("_keep").alias("_kept")).where("_kept = 0").select("tag", F.lit(1).alias("_all"))
    member = split.join(whole, "tag", "left").join(ranked, ["tag", "_isle"], "left")
    member = member.withColumn("band_id", F.when(F.col("_all") == 1, F.lit(1)).otherwise(F.col("band_id")))
    member = settle(member.where(F.col("band_id").isNotNull()).select("tag", "band_id", "value", "_w", "_total"))
    return _band_limits(series, member, k, margin)


def _band_limits(series: Series, member: DataFrame, k: float, margin: float) -> DataFrame:
    """Median, scale, tail quantiles and limits per (tag, band) of values counted by ``_w``."""
    keys = ["tag", "band_id"]
    probs = {"_med": ("value", 0.5)} | {f"q{p:02d}": ("value", p / 100) for p in (1, 5, 95, 99)}
    stats = quantiles(member, keys, probs, series.tag_rows, weight="_w")
    sizes = member.groupBy(*keys).agg(
        F.sum("_w").alias("_n"),
        F.max("_total").alias("_total"),
        (F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("_mean"),
    )
    stats = settle(stats.join(sizes, keys))
    near = member.join(stats.select(*keys, "_med", "_mean"), keys)
    near = near.withColumns({"_dev": F.abs(F.col("value") - F.col("_med")), "_sq": F.pow(F.col("value") - F.col("_mean"), 2)})
    mads = quantiles(near, keys, {"_mad": ("_dev", 0.5)}, series.tag_rows, weight="_w")
    spread = near.groupBy(*keys).agg(F.sum(F.col("_sq") * F.col("_w")).alias("_ss"))
    stats = stats.join(mads, keys).join(spread, keys)
    mad = MAD_K * F.col("_mad")
    std = F.sqrt(F.try_divide(F.col("_ss"), F.col("_n") - 1))
    scale = F.coalesce(F.when(mad >= EPS, mad), F.when(std >= EPS, std), F.lit(EPS))
    lower = F.least(F.col("_med") - k * scale, F.col("q01"))
    upper = F.greatest(F.col("_med") + k * scale, F.col("q99"))
    lower, upper = widened(lower, upper, scale, margin)
    return stats.select(
        *keys,
        F.col("_n").alias("band_count"),
        (F.col("_n") / F.col("_total")).alias("band_fraction"),
        F.col("_med").alias("band_median"),
        scale.alias("band_scale"),
        "q01",
        "q05",
        "q95",
        "q99",
        lower.alias("lower_limit"),
        upper.alias("upper_limit"),
    )


def consensus_baseline(
    series: Series,
    trim: float = 0.15,
    diff_trim: float | None = None,
    off_share: float = 0.05,
    abs_floor: float = 1e-9,
    rel_floor: float = 0.10,
    min_mad: float = 1e-9,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Median, MAD scale, quartiles and step scale per tag; a tag that is often near zero uses its active part.

    ``steps`` may bring all readings as ``tag, value, delta`` where the step from the reading before is known.
    """
    diff_trim = trim if diff_trim is None else diff_trim
    full = center_mad(series, {"f": "value"})
    floor = F.greatest(F.lit(abs_floor), rel_floor * F.greatest(scale_of("f", "floor", min_mad), F.lit(abs_floor)))
    full = full.select("tag", F.col("f_n").alias("count"), floor.alias("off_floor"))
    df = series.attach(full, settle(diff(series)) if steps is None else steps)
    off = F.abs("value") <= F.col("off_floor")
    shares = df.groupBy("tag").agg(
        (F.count_if(off) / F.count("value")).alias("_off"), F.count_if(~off).alias("_on"), F.count("delta").alias("_dn")
    )
    shares = shares.select("tag", (F.col("_off") >= off_share).alias("off_mode"), "_on", "_dn")
    df = series.attach(shares, df)
    active = F.col("off_mode") & (F.col("_on") > 0) & off
    df = df.withColumn("_a", F.when(~active, F.col("value")))
    inner = F.greatest(F.lit(25), F.least(F.lit(100), F.floor(F.col("count") * F.lit(0.35))))
    need = full.select("tag", inner.alias("_need"))
    df = _trimmed(series, df, need, trim, "_a", "_level")
    few = F.greatest(F.lit(25), F.least(F.lit(80), F.floor(F.col("_dn") / 3)))
    df = _trimmed(series, df, shares.select("tag", few.alias("_need")), diff_trim, "delta", "_step")
    stats = center_mad(series, {"l": "_level", "d": "_step"}, df, {"q1": ("_level", 0.25), "q3": ("_level", 0.75)})
    mad = scale_of("l", "floor", min_mad)
    iqr = F.col("q3") - F.col("q1")
    table = stats.select(
        "tag",
        F.col("l_center").alias("median"),
        mad.alias("mad_scale"),
        "q1",
        "q3",
        F.when(iqr <= 0, mad).otherwise(iqr).alias("iqr"),
        F.coalesce(scale_of("d", "floor", min_mad), F.lit(min_mad)).alias("diff_scale"),
    )
    return table.join(full, "tag").join(shares.select("tag", "off_mode"), "tag")


def _trimmed(series: Series, df: DataFrame, need: DataFrame, tail: float, column: str, name: str) -> DataFrame:
    if tail <= 0:
        return df.withColumn(name, F.col(column))
    bounds = series.quantiles({"_lo": (column, tail), "_hi": (column, 1 - tail)}, df)
    df = series.attach(bounds, df).withColumn("_in", F.col(column).between(F.col("_lo"), F.col("_hi")))
    sizes = df.groupBy("tag").agg(F.count(column).alias("_n"), F.count_if("_in").alias("_kept")).join(need, "tag")
    sizes = sizes.select("tag", ((F.col("_n") >= 10) & (F.col("_kept") >= F.col("_need"))).alias("_trim"))
    df = series.attach(sizes, df)
    return df.withColumn(name, F.when(~F.col("_trim") | F.col("_in"), F.col(column))).drop("_lo", "_hi", "_in", "_trim")


def display_limits(baseline: DataFrame, k_z: float = 4.0, k_fence: float = 3.0) -> DataFrame:
    """Drift and strong bands of the consensus baseline for display."""
    med, scale = F.col("median"), F.col("mad_scale")
    strong = 1.25 * k_z
    low = F.least(med - strong * scale, F.col("q1") - k_fence * F.col("iqr"))
    high = F.greatest(med + strong * scale, F.col("q3") + k_fence * F.col("iqr"))
    return baseline.select(
        "tag",
        med.alias("baseline_center"),
        scale.alias("baseline_scale"),
        (med - k_z * scale).alias("drift_lower_limit"),
        (med + k_z * scale).alias("drift_upper_limit"),
        low.alias("strong_anomaly_lower_limit"),
        high.alias("strong_anomaly_upper_limit"),
    )


def percentile_display_limits(profile: DataFrame) -> DataFrame:
    """Drift band P5..P95, strong band P1..P99, scale (P95 - P5) / 3.5."""
    gap = F.col("p95") - F.col("p05")
    return profile.select(
        "tag",
        ((F.col("p05") + F.col("p95")) / 2).alias("baseline_center"),
        F.when(gap > 0, F.greatest(gap / 3.5, F.lit(1e-9))).otherwise(1e-9).alias("baseline_scale"),
        F.col("p05").alias("drift_lower_limit"),
        F.col("p95").alias("drift_upper_limit"),
        F.col("p01").alias("strong_anomaly_lower_limit"),
        F.col("p99").alias("strong_anomaly_upper_limit"),
    )
