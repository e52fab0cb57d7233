"""Detectors that score each tag against its own clean behaviour."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions.classes import binary_status, crossed_limit, limit_status, z_direction, z_ladder
from sensorium.functions.scalar import severity_band, yes
from sensorium.operators import clean, limits
from sensorium.operators.stats import MAD_K, center_mad, robust_scale
from sensorium.operators.windows import (
    deviation_features,
    diff,
    flatline,
    jump,
    persist_in_window,
    run_length,
)
from sensorium.plans.attach import attach
from sensorium.plans.quantiles import quantiles
from sensorium.series import Series
from sensorium.session import settle

Detector = Callable[[Series], DataFrame]
_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, fn: Detector) -> None:
    """Make a detector available by name; any ``Series -> DataFrame`` will do."""
    _DETECTORS[name] = fn


def detector(name: str) -> Detector:
    return _DETECTORS[name]


# -- single threshold and labels ----------------------------------------------


def simple_robust(series: Series, threshold: float = 3.5) -> DataFrame:
    """Readings with |robust z| above the threshold (tags with a zero MAD or under 5 values have none)."""
    stats = center_mad(series, {"v": "value"})
    ok = (F.col("v_n") >= 5) & (F.col("v_mad") > 0)
    table = stats.select("tag", F.col("v_center").alias("_c"), F.when(ok, MAD_K * F.col("v_mad") + 1e-12).alias("_s"))
    df = series.attach(table).withColumn("robust_z", (F.col("value") - F.col("_c")) / F.col("_s"))
    return df.where(F.abs("robust_z") > threshold).drop("_c", "_s")


def simple_status(series: Series, threshold: float = 3.5) -> DataFrame:
    """Per tag: whether flagged, first time and number of flags; quiet tags count 0."""
    flags = simple_robust(series, threshold).groupBy("tag").agg(
        F.min("ts").alias("first_outlier_ts"), F.count(F.lit(1)).alias("num_flags")
    )
    tags = series.df.groupBy("tag").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    df = tags.join(flags, "tag", "left").withColumn("num_flags", F.coalesce("num_flags", F.lit(0)).cast("long"))
    return df.select("tag", (F.col("num_flags") > 0).alias("is_outlier"), "first_outlier_ts", "num_flags")


LEVELS = 8


def _cuts(trees: int, seed: int) -> np.ndarray:
    """Ends of all leaves' intervals but the last, as shares of a tag's range: (trees, 2**LEVELS - 1), rising.

    Every cell is cut at a share of its own width that comes from the hash of seed, tree, level and cell.
    """
    ends = np.tile([0.0, 1.0], (trees, 1))
    for level in range(LEVELS):
        share = np.array([[int(hashlib.md5(f"{seed}:{t}:{level}:{c}".encode()).hexdigest()[:13], 16) / 2**52 for c in range(2**level)] for t in range(trees)])
        cuts = ends[:, :-1] + (ends[:, 1:] - ends[:, :-1]) * share
        both = np.empty((trees, 2 ** (level + 1) + 1))
        both[:, ::2], both[:, 1::2] = ends, cuts
        ends = both
    return ends[:, 1:-1]


def _depths(count: np.ndarray, trees: int) -> np.ndarray:
    """Path length that every leaf stands for: down to the first cell with at most one reading, or the leaf."""
    n = count.reshape(trees, 2**LEVELS).astype(float)
    more = np.maximum(n, 2.0)
    depth = LEVELS + np.where(n > 1, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, 0.0)
    for level in range(LEVELS, -1, -1):
        whole = n.reshape(trees, 2**level, -1).sum(2).repeat(2 ** (LEVELS - level), 1)
        depth = np.where(whole <= 1, level, depth)
    return depth.ravel()


def _leaves(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All trees' cuts in one rising line, and each tree's leaf (numbered through) of every gap between them: (gaps, trees)."""
    trees, width = cuts.shape
    order = np.argsort(cuts, axis=None, kind="stable")
    below = np.zeros((cuts.size + 1, trees), np.int32)
    below[np.arange(1, cuts.size + 1), order // width] = 1
    return cuts.ravel()[order], below.cumsum(0, dtype=np.int32) + np.arange(trees, dtype=np.int32) * 2**LEVELS


def tail_isolation(series: Series, share: float = 0.02, trees: int = 50, seed: int = 42) -> DataFrame:
    """Readings with their mean isolation depth and a flag on the most isolated share.

    Every tree cuts a tag's range at random, cell by cell, ``LEVELS`` times. All trees' cuts together part the range
    into gaps, and readings of one gap share their cell in every tree. So a reading is placed in its gap once, Spark
    counts all readings per tag and gap, and a tag's depths come from its counted gaps, of which there are at most
    ``trees * 2**LEVELS`` however many readings it has.
    """
    base = series.df.where(F.col("value").isNotNull())
    ends = base.groupBy("tag").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    line, leaves = _leaves(_cuts(trees, seed))

    @F.pandas_udf("int")
    def gap_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(line, at.to_numpy(), "left").astype(np.int32))

    at = F.when(width > 0, (F.col("value") - F.col("_lo")) / width).otherwise(0.0)
    placed = settle(series.attach(ends, base).select("tag", "ts", "row_index", "value", gap_of(at).alias("gap")))
    shared = base.sparkSession.sparkContext.broadcast(leaves)

    def deepen(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = shared.value[pdf["gap"].to_numpy()]
        weight = np.repeat(pdf["n"].to_numpy(float), trees)
        count = np.bincount(leaf.ravel(), weight, trees * 2**LEVELS)
        return pdf.assign(isolation_depth=np.round(_depths(count, trees)[leaf].mean(1), 9))

    counted = placed.groupBy("tag", "gap").agg(F.count(F.lit(1)).alias("n"))
    kind = placed.schema["tag"].dataType.simpleString()
    depths = settle(counted.groupBy("tag").applyInPandas(deepen, f"tag {kind}, gap int, n long, isolation_depth double"))
    cut = quantiles(depths, ["tag"], {"_cut": ("isolation_depth", share)}, len(line) + 1, "n")
    gaps = attach(depths.drop("n"), cut, "tag", series.tags)
    gaps = settle(gaps.withColumn("isolated", F.col("isolation_depth") < F.round("_cut", 9)).drop("_cut"))
    return attach(placed, gaps, ["tag", "gap"], series.tags * (len(line) + 1)).drop("gap")


def status_labels(series: Series, isolation: DataFrame | None = None) -> DataFrame:
    """First matching label: missing, strong, mild, flatline, jump, isolation, normal."""
    scale = robust_scale(series, "nan_poison").select("tag", "center", "scale")
    df = series.attach(scale).withColumn("z_score", (F.col("value") - F.col("center")) / F.col("scale"))
    df = jump(series, flatline(series.lane(df)).done())
    if isolation is not None:
        df = df.join(isolation.select("tag", "ts", "row_index", "isolated"), ["tag", "ts", "row_index"], "left")
    else:
        df = df.withColumn("isolated", F.lit(False))
    z = F.abs("z_score")
    status = (
        F.when(F.col("value").isNull(), "missing")
        .when(z > 5, "strong_outlier")
        .when(z > 3, "mild_outlier")
        .when(F.col("flatline"), "flatline")
        .when(F.col("jump"), "sudden_jump")
        .when(F.col("isolated"), "isolation_outlier")
        .otherwise("normal")
    )
    return df.withColumn("status", status).select("ts", "tag", "value", "z_score", "flatline", "jump", "status")


# -- z ladder on clean limits ----------------------------------------------------


def classify_results(series: Series, table: DataFrame) -> DataFrame:
    """Join limits to readings and read off class, status, direction and the limit crossed."""
    df = series.attach(table)
    df = df.withColumn("value_z", (F.col("value") - F.col("center")) / F.col("scale"))
    df = df.withColumn("abs_z", F.abs("value_z"))
    df = df.withColumn(
        "final_class", z_ladder(F.col("abs_z"), F.col("drift_z"), F.col("drift_anomaly_z"), F.col("strong_anomaly_z"))
    )
    df = df.withColumn("final_status", F.when(F.col("final_class") == "Normal", "Normal").otherwise("Abnormal"))
    df = df.withColumn("direction", z_direction(F.col("final_status"), F.col("value_z")))
    return df.withColumn("limit_crossed", crossed_limit(F.col("final_class"), F.col("direction")))


def auto_clean_rows(series: Series) -> DataFrame:
    return clean.auto_clean(clean.stability_score(series))


def auto_clean(series: Series, method: str = "std") -> DataFrame:
    """Clean window by stability, mean/std limits, z ladder 3 / 3.5 / 5."""
    table = limits.clean_limits(series, auto_clean_rows(series), method)
    return classify_results(series, limits.fences(table, F.lit(3.0), F.lit(3.5), F.lit(5.0)))


def all_rows_baseline(series: Series, method: str = "std") -> DataFrame:
    """The same ladder with every reading as reference."""
    rows = series.df.groupBy("ts").agg(F.lit(True).alias("clean"))
    table = limits.clean_limits(series, rows, method)
    return classify_results(series, limits.fences(table, F.lit(3.0), F.lit(3.5), F.lit(5.0)))


def adaptive(
    series: Series,
    hybrid: bool = False,
    limits_hook: Callable[[Series, DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per-tag thresholds on clean limits; a hook may change the limits first."""
    rows = auto_clean_rows(series)
    table = limits.clean_limits(series, rows)
    hook = limits.hybrid_limits if hybrid else limits_hook
    if hook is not None:
        table = hook(series, rows, table)
    return classify_results(series, limits.adaptive_thresholds(series, rows, table))


# -- distance from a band ----------------------------------------------------------


def _outside_band(series: Series, table: DataFrame, drift: float = 2.0, anomaly: float = 3.5, strong: float = 5.0) -> DataFrame:
    df = series.attach(table, how="inner")
    x, lower, upper = F.col("value"), F.col("lower_limit"), F.col("upper_limit")
    scale = F.greatest(F.col("reference_scale"), F.lit(1e-9))
    distance = F.when(x < lower, x - lower).when(x > upper, x - upper).otherwise(0.0)
    df = df.withColumns(
        {
            "value_z": (x - F.col("reference_median")) / scale,
            "distance_z": distance / scale,
            "raw_outside": yes((x < lower) | (x > upper)),
            "limit_status": limit_status(x, lower, upper),
            "direction": F.when(x < lower, "Down").when(x > upper, "Up").otherwise("Normal"),
        }
    )
    df = persist_in_window(series.lane(df), "raw_outside", "persistent_outside").done()
    far = F.abs("distance_z")
    df = df.withColumn("strong_outside", far >= strong)
    df = df.withColumn(
        "effective_outside", F.col("strong_outside") | (F.col("raw_outside") & F.col("persistent_outside"))
    )
    final = (
        F.when(~F.col("effective_outside"), "Normal")
        .when(F.col("strong_outside"), "Strong Anomaly")
        .when(far < anomaly, "Drift")
        .otherwise("Drift + Anomaly")
    )
    return df.withColumn("final_class", final).withColumn("final_status", binary_status("final_class"))


def clean_window(series: Series) -> DataFrame:
    """Band learned on the clean window only."""
    rows = clean.anchored_window(series)
    return _outside_band(series, limits.clean_window_limits(series, rows))


def clean_anchored(series: Series) -> DataFrame:
    """Band learned on all readings that resemble the clean window."""
    rows = clean.anchored_window(series)
    return _outside_band(series, limits.similar_history_limits(series, rows))


def deviation_spike(series: Series) -> DataFrame:
    """Level outliers told apart by spike, change and persistence."""
    features = settle(deviation_features(series))
    rows = clean.deviation_window(series, features)
    table, marked = limits.spike_free_limits(series, features, rows)
    df = series.attach(table, marked, how="inner")
    x, lower, upper = F.col("value"), F.col("lower_limit"), F.col("upper_limit")
    df = df.withColumns(
        {
            "value_z": (x - F.col("reference_median")) / F.col("reference_scale"),
            "is_level_outlier": yes((x < lower) | (x > upper)),
            "spike_flag": F.abs("spike_z") > 4.0,
            "change_flag": F.abs("change_z") > 4.0,
            "volatility_flag": F.abs("volatility_z") > 4.0,
            "limit_status": limit_status(x, lower, upper, "Within Limit"),
            "direction": F.when(x < lower, "Down").when(x > upper, "Up").otherwise("Normal"),
        }
    )
    df = persist_in_window(series.lane(df), "is_level_outlier", "persistent_outlier").done()
    extreme = (F.abs("value_z") >= 5) | (F.abs("spike_z") >= 5) | (F.abs("change_z") >= 5)
    shaky = F.col("spike_flag") | F.col("change_flag")
    final = (
        F.when(x.isNull(), "Unknown")
        .when(~F.col("is_level_outlier"), "Normal")
        .when(extreme, "Strong Anomaly")
        .when(~F.col("persistent_outlier"), F.when(shaky, "Drift + Anomaly").otherwise("Normal"))
        .when(F.abs("value_z") < 3.75, "Drift")
        .otherwise("Drift + Anomaly")
    )
    return df.withColumn("final_class", final).withColumn("final_status", binary_status("final_class"))


def _joined_types() -> Column:
    named = F.array_compact(
        F.array(
            F.when(F.col("outside_limit"), "Outside Limit"),
            F.when(F.col("inside_spike"), "Within Limit Spike"),
            F.when(F.col("inside_error_change"), "Within Limit Error Change"),
            F.when(F.col("persistent_deviation"), "Within Limit Persistent Deviation"),
        )
    )
    return F.when(F.size(named) == 0, "Normal").otherwise(F.array_join(named, " + "))


def score_against_limits(readings: DataFrame) -> DataFrame:
    """Row-wise part of the in-limit detector: z values and flags, given joined limits and ``delta``.

    It needs no neighbours beyond ``delta`` and so also serves streams.
    """
    x, lower, upper = F.col("value"), F.col("lower_limit"), F.col("upper_limit")
    error = x - F.col("reference_median")
    step = F.coalesce("delta", F.lit(0.0)) - F.col("delta_center")
    df = readings.withColumns(
        {
            "error": error,
            "value_z": error / F.col("reference_scale"),
            "delta_z": step / F.greatest(F.coalesce("delta_scale", F.lit(1e-9)), F.lit(1e-9)),
            "deviation_z": (F.abs(error) - F.col("abs_error_center")) / F.col("abs_error_scale"),
            "within_limits": yes(x.between(lower, upper)),
            "inside_central": yes(x.between(F.col("central_lower"), F.col("central_upper"))),
        }
    )
    jumpy = F.col("within_limits") & yes(F.abs("delta_z") >= 4.0)
    return df.withColumns(
        {
            "outside_limit": ~F.col("within_limits"),
            "inside_spike": jumpy,
            "inside_error_change": jumpy,
            "inside_deviation": F.col("within_limits") & ~F.col("inside_central") & yes(F.col("deviation_z") >= 3.0),
        }
    )


def deviation_inside(series: Series, rows: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Outside-limit classes plus spikes, error changes and lasting deviations inside the limits."""
    if table is None:
        rows = clean.longest_stable_run(series) if rows is None else rows
        table = limits.clean_like_limits(series, rows)
    df = score_against_limits(series.attach(table, diff(series), how="inner"))
    lane = run_length(series.lane(df), "outside_limit", "outside_run")
    lane = run_length(lane, "inside_deviation", "deviation_run")
    df = lane.done()
    df = df.withColumns(
        {"persistent_outside": F.col("outside_run") >= 2, "persistent_deviation": F.col("deviation_run") >= 2}
    )
    z = F.abs("value_z")
    outside = (
        F.when(z.isNull(), "Unknown")
        .when(z >= 7.0, "Strong Anomaly")
        .when(F.col("persistent_outside") & (z < 4.5), "Drift")
        .otherwise("Drift + Anomaly")
    )
    final = (
        F.when(F.col("outside_limit"), outside)
        .when(F.col("inside_spike") | F.col("inside_error_change"), "Drift + Anomaly")
        .when(F.col("persistent_deviation"), "Drift")
        .otherwise("Normal")
    )
    x, lower, upper = F.col("value"), F.col("lower_limit"), F.col("upper_limit")
    direction = (
        F.when(x < lower, "Down")
        .when(x > upper, "Up")
        .when(F.col("within_limits") & (F.col("error") < 0), "Within Limit - Down Deviation")
        .when(F.col("within_limits") & (F.col("error") > 0), "Within Limit - Up Deviation")
        .otherwise("Normal")
    )
    return df.withColumns(
        {
            "limit_status": limit_status(x, lower, upper),
            "direction": direction,
            "outlier_type": _joined_types(),
            "final_class": final,
        }
    ).withColumn("final_status", binary_status("final_class"))


def nearest_band(series: Series, bands: DataFrame) -> DataFrame:
    """Signed distance of each reading to its nearest band, 0 inside; the lowest band id wins a tie."""
    packed = bands.groupBy("tag").agg(
        F.sort_array(
            F.collect_list(F.struct("band_id", "lower_limit", "upper_limit", "band_scale"))
        ).alias("_bands")
    )
    df = attach(series.df, packed, "tag", series.tags, "inner")
    x = F.col("value")

    def measure(b: Column) -> Column:
        scale = F.when(b["band_scale"] > 0, b["band_scale"]).otherwise(1e-9)
        score = (
            F.when(x < b["lower_limit"], (x - b["lower_limit"]) / scale)
            .when(x > b["upper_limit"], (x - b["upper_limit"]) / scale)
            .otherwise(0.0)
        )
        return F.struct(
            F.abs(score).alias("a"),
            b["band_id"].alias("id"),
            score.alias("s"),
            b["lower_limit"].alias("lo"),
            b["upper_limit"].alias("hi"),
        )

    # Bands per tag are few (see value_bands), so this stays a short array per reading.
    df = df.withColumn("_best", F.when(x.isNotNull(), F.array_min(F.transform("_bands", measure))))
    return df.withColumns(
        {
            "inside_band": yes(F.exists("_bands", lambda b: x.between(b["lower_limit"], b["upper_limit"]))),
            "band_id": F.col("_best.id"),
            "band_distance_z": F.col("_best.s"),
            "lower_limit": F.col("_best.lo"),
            "upper_limit": F.col("_best.hi"),
        }
    ).drop("_bands", "_best")


def regime_bands(series: Series, drift: float = 3.0, anomaly: float = 3.5, strong: float = 5.0) -> DataFrame:
    """Distance to the nearest learned value band, with persistence."""
    bands = limits.value_bands(series, clean.stable_rows_for_bands(series))
    df = nearest_band(series, bands).withColumn("outside_band", ~F.col("inside_band"))
    df = persist_in_window(series.lane(df), "outside_band", "persistent_outside").done()
    score = F.abs("band_distance_z")
    df = df.withColumn("strong_outside", yes(score >= strong))
    df = df.withColumn(
        "effective_outside", F.col("strong_outside") | (F.col("outside_band") & F.col("persistent_outside"))
    )
    final = (
        F.when(~F.col("effective_outside"), "Normal")
        .when(score.isNull(), "Unknown")
        .when(score >= strong, "Strong Anomaly")
        .when(~F.col("persistent_outside") | (score < drift), "Normal")
        .when(score < anomaly, "Drift")
        .otherwise("Drift + Anomaly")
    )
    x = F.col("value")
    direction = (
        F.when(F.col("inside_band"), "Normal")
        .when(x < F.col("lower_limit"), "Down")
        .when(x > F.col("upper_limit"), "Up")
        .otherwise("Unknown")
    )
    return df.withColumns({"direction": direction, "final_class": final}).withColumn(
        "final_status", binary_status("final_class")
    )


def classify_points_simple(series: Series, critical: tuple[str, ...] = ()) -> DataFrame:
    """Outlier, process issue or both from plain z values and how many tags move together."""
    stats = series.df.groupBy("tag").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    df = series.attach(stats)
    z = F.when(F.col("_s") > 0, F.coalesce((F.col("value") - F.col("_m")) / F.col("_s"), F.lit(0.0))).otherwise(0.0)
    df = df.withColumn("_z", z).where(F.col("value").isNotNull())
    moved = df.where(F.abs("_z") >= 2.0)
    # One timestamp has at most one reading per tag, so the list is as short as the tag list.
    peers = moved.groupBy("ts").agg(
        F.count_if(F.abs("_z") > 2.0).alias("_peers"), F.sort_array(F.collect_list("tag")).alias("_moved")
    )
    df = df.join(peers, "ts", "left")
    n = F.coalesce("_peers", F.lit(0))
    special = F.col("tag").isin(*critical) if critical else F.lit(False)
    outlier = F.abs("_z") >= 2.5
    process = ((n >= 2) & (F.abs("_z") >= 1.5)) | (special & (F.abs("_z") >= 2.0))
    status = (
        F.when(outlier & process, "Both")
        .when(outlier, "Outlier Only")
        .when(process, "Process Issue Only")
        .otherwise("Normal")
    )
    out_score = F.round(F.abs("_z"), 2)
    proc_score = F.round(F.least(F.lit(5.0), n * 1.2 + F.when(special, 0.5).otherwise(0.0)), 2)
    others = F.array_except(F.coalesce("_moved", F.array().cast("array<string>")), F.array("tag"))
    return df.withColumn("status", status).where("status <> 'Normal'").select(
        "tag",
        "ts",
        "value",
        "status",
        out_score.alias("outlier_score"),
        proc_score.alias("process_issue_score"),
        (F.col("_m") - 2.5 * F.col("_s")).alias("lower_limit"),
        (F.col("_m") + 2.5 * F.col("_s")).alias("upper_limit"),
        F.slice(others, 1, 5).alias("related_tags"),
        severity_band(F.greatest(out_score, proc_score)).alias("severity"),
    )


for _name, _fn in {
    "auto_clean": auto_clean,
    "all_rows": all_rows_baseline,
    "adaptive": adaptive,
    "clean_window": clean_window,
    "clean_anchored": clean_anchored,
    "deviation_spike": deviation_spike,
    "deviation_inside": deviation_inside,
    "regime_bands": regime_bands,
}.items():
    register_detector(_name, _fn)
