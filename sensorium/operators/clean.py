"""Row scores across tags and the search for the clean reference period.

A row is one timestamp. Scores are first reduced per tag and timestamp, then to one
row per timestamp; window means come from running sums, so a window may be any share
of the data without any task holding that share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions.scalar import clip, one, yes
from sensorium.operators.stats import center_mad, global_quantiles, scale_of
from sensorium.operators.windows import deviation_features, diff
from sensorium.plans.attach import beside
from sensorium.plans.lane import Lane
from sensorium.series import Series
from sensorium.session import settle

EPS = 1e-9
DIGITS = 9


def stability_score(series: Series, cap: float = 10.0) -> DataFrame:
    """Per timestamp: 0.75·median of clipped |z| + 0.25·median of clipped |change of z| over tags."""
    probs = {"q25": ("value", 0.25), "q75": ("value", 0.75)}
    stats = center_mad(series, {"v": "value"}, probs=probs)
    stats = stats.select(
        "tag", F.col("v_center").alias("_c"), scale_of("v", "ladder", 1e-12, F.col("q75") - F.col("q25")).alias("_s")
    )
    df = series.attach(stats).withColumn("_z", (F.col("value") - F.col("_c")) / F.col("_s"))
    df = series.lane(df).rolling(1, 0, lambda w: {"_dz": F.abs(F.col("_z") - F.lag("_z").over(w))}).done()
    rows = settle(df.groupBy("ts").agg(
        F.median(clip(F.abs("_z"), 0, cap)).alias("_level"),
        F.median(clip("_dz", 0, cap)).alias("_change"),
    ))
    fills = global_quantiles(rows, {"_ml": ("_level", 0.5), "_mc": ("_change", 0.5)})
    score = 0.75 * F.coalesce("_level", "_ml") + 0.25 * F.coalesce("_change", "_mc")
    return beside(rows, fills).select("ts", score.alias("score"))


def best_window(
    rows: DataFrame, score: str, size: Callable[[Column], Column], min_share: float = 1.0, least: int = 1
) -> DataFrame:
    """Mark the window of rows with the lowest mean score (the earliest such window).

    ``size`` turns the number of rows into a window length. A window counts once it
    holds ``max(least, min_share·length)`` rows. Means are compared at 9 decimals.
    """
    rows = settle(rows)
    count = rows.agg(F.count(F.lit(1)).alias("_n"))
    lane = Lane(rows, [], ["ts"]).numbered("_p").running({"_cs": ("sum", score), "_cn": ("count", score)})
    df = beside(lane.done(), count.select(size(F.col("_n")).cast("long").alias("window_rows")))
    left = df.select(
        (F.col("_p") + F.col("window_rows")).alias("_p"), F.col("_cs").alias("_ls"), F.col("_cn").alias("_ln")
    )
    df = df.join(left, "_p", "left")
    seen = F.col("_cn") - F.coalesce("_ln", F.lit(0))
    total = F.coalesce("_cs", F.lit(0.0)) - F.coalesce("_ls", F.lit(0.0))
    need = F.greatest(F.lit(least), F.floor(F.col("window_rows") * F.lit(min_share)))
    df = settle(df.withColumn("rolling_score", F.when(seen >= need, total / seen)))
    lowest = F.struct(F.round("rolling_score", DIGITS).alias("s"), F.col("_p").alias("p"))
    best = df.agg(F.min(F.when(F.col("rolling_score").isNotNull(), lowest)).alias("b")).select(F.col("b.p").alias("_best"))
    end = F.col("_best")
    inside = yes(F.col("_p").between(end - F.col("window_rows") + 1, end))
    return beside(df, best).withColumn("in_window", inside).drop("_p", "_cs", "_cn", "_ls", "_ln", "_best")


def auto_clean(
    rows: DataFrame, fraction: float = 0.15, min_points: int = 30, trim: float = 0.85
) -> DataFrame:
    """Best window of the stability score, trimmed to its calmer rows: ``ts, score, clean``."""

    def size(n: Column) -> Column:
        wish = F.greatest(F.rint(n * F.lit(fraction)), F.lit(min_points))
        half = F.greatest(F.least(F.floor(n * 0.5), n), F.lit(min_points))
        return F.least(wish, half, n)

    df = best_window(rows, "score", size, 0.7, 3)
    df = df.withColumn("_in", F.when(F.col("in_window"), F.col("score")))
    cut = global_quantiles(df, {"_cut": ("_in", trim)})
    df = beside(df, cut).withColumn("_calm", yes(F.col("_in") <= F.col("_cut")))
    sizes = df.agg(F.sum(one(F.col("_calm"))).alias("_kept"), F.count(F.lit(1)).alias("_n"))
    clean = (
        F.when(F.col("_n") <= min_points, True)
        .when(F.col("_kept") >= min_points, F.col("_calm"))
        .otherwise(F.col("in_window"))
    )
    return beside(df, sizes).select("ts", "score", "rolling_score", clean.alias("clean"))


def smallest_k(rows: DataFrame, score: str, k: Column, name: str) -> DataFrame:
    """Mark the k rows with the lowest score, earliest first on ties; k may be a column."""
    lane = Lane(rows, [], [score, "ts"]).numbered("_rank")
    return lane.done().withColumn(name, F.col("_rank") <= k).drop("_rank")


def bad_shares(series: Series, df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per timestamp the share of all tags whose flag holds; a missing reading is not bad."""
    tags = F.lit(float(max(series.tags, 1)))
    return df.groupBy("ts").agg(*[(F.sum(one(f)) / tags).alias(name) for name, f in flags.items()])


def _z_unit(series: Series, df: DataFrame, columns: dict[str, str], policy: str) -> DataFrame:
    stats = center_mad(series, columns, df)
    picks = [
        piece
        for p in columns
        for piece in (F.col(f"{p}_center").alias(f"_c_{p}"), scale_of(p, policy, EPS).alias(f"_s_{p}"))
    ]
    df = series.attach(stats.select("tag", *picks), df)
    for p, c in columns.items():
        df = df.withColumn(f"_z_{p}", F.abs((F.col(c) - F.col(f"_c_{p}")) / F.col(f"_s_{p}")))
    return df


def _level_and_jump(series: Series, level: float, jump: float) -> DataFrame:
    df = settle(diff(series)).withColumn("_jump", F.coalesce(F.abs("delta"), F.lit(0.0)))
    df = _z_unit(series, df, {"l": "value", "j": "_jump"}, "unit")
    return bad_shares(series, df, {"level_bad": F.col("_z_l") > level, "jump_bad": F.col("_z_j") > jump})


def clean_score_anchored(series: Series, level: float = 3.5, jump: float = 4.0, crowd: float = 0.10) -> DataFrame:
    """0.75·level share + 0.25·jump share, plus 0.25 when too many tags are off."""
    rows = _level_and_jump(series, level, jump)
    penalty = F.when(F.col("level_bad") > crowd, 0.25).otherwise(0.0)
    return rows.withColumn("score", 0.75 * F.col("level_bad") + 0.25 * F.col("jump_bad") + penalty)


def clean_score_deviation(series: Series, features: DataFrame, level: float = 3.5, other: float = 4.0) -> DataFrame:
    """Weighted shares of level, spike, change, volatility and missing readings."""
    rows = bad_shares(
        series,
        features,
        {
            "level_bad": F.abs("level_z") > level,
            "spike_bad": F.abs("spike_z") > other,
            "change_bad": F.abs("change_z") > other,
            "volatility_bad": F.abs("volatility_z") > other,
            "present": F.col("value").isNotNull(),
        },
    )
    score = (
        0.35 * F.col("level_bad")
        + 0.25 * F.col("spike_bad")
        + 0.25 * F.col("change_bad")
        + 0.10 * F.col("volatility_bad")
        + 0.05 * (1 - F.col("present"))
    )
    return rows.withColumn("score", score)


def clean_score_steps(series: Series, level: float = 3.5, step: float = 4.0) -> DataFrame:
    """0.5·level share + 0.25·step share + 0.25·error-change share.

    The error is the value minus a constant, so its change equals the step itself.
    """
    df = settle(diff(series)).withColumn("_d0", F.coalesce("delta", F.lit(0.0)))
    df = _z_unit(series, df, {"l": "value", "d": "_d0"}, "std1")
    rows = bad_shares(series, df, {"level_bad": F.col("_z_l") > level, "step_bad": F.col("_z_d") > step})
    return rows.withColumn("score", 0.5 * F.col("level_bad") + 0.25 * F.col("step_bad") + 0.25 * F.col("step_bad"))


def stable_rows_for_bands(series: Series, level: float = 3.5, jump: float = 4.0, share: float = 0.45) -> DataFrame:
    """Rows whose level/jump score is at or below its ``share`` quantile."""
    rows = settle(
        _level_and_jump(series, level, jump).withColumn(
            "score", 0.75 * F.col("level_bad") + 0.25 * F.col("jump_bad")
        )
    )
    cut = global_quantiles(rows, {"cutoff": ("score", share)})
    return beside(rows, cut).withColumn("stable", F.col("score") <= F.col("cutoff"))


def stable_rows(series: Series, level: float = 3.5, share: float = 0.20) -> DataFrame:
    """Rows with at most ``share`` of the tags beyond the level z."""
    df = _z_unit(series, series.df, {"l": "value"}, "std1")
    rows = bad_shares(series, df, {"bad_fraction": F.col("_z_l") > level})
    return rows.withColumn("stable", F.col("bad_fraction") <= share)


def anchored_window(series: Series, scores: DataFrame | None = None) -> DataFrame:
    """Clean window of 12 % of the rows, between 30 and 180."""
    scores = clean_score_anchored(series) if scores is None else scores

    def size(n: Column) -> Column:
        wish = F.greatest(F.lit(30), F.least(F.lit(180), F.floor(n * F.lit(0.12))))
        return F.when(wish >= n, F.greatest(F.lit(5), F.floor(n * F.lit(0.25)))).otherwise(wish)

    return best_window(scores, "score", size).withColumnRenamed("in_window", "clean")


def deviation_window(series: Series, features: DataFrame | None = None) -> DataFrame:
    """Clean window of 15 % of the rows, between 30 and 200."""
    features = deviation_features(series) if features is None else features

    def size(n: Column) -> Column:
        wish = F.greatest(F.lit(30), F.least(F.lit(200), F.floor(n * F.lit(0.15))))
        return F.when(wish >= n, F.greatest(F.lit(5), F.floor(n * F.lit(0.30)))).otherwise(wish)

    scores = clean_score_deviation(series, features)
    return best_window(scores, "score", size).withColumnRenamed("in_window", "clean")


def longest_stable_run(series: Series, quantile: float = 0.35, min_rows: int = 30, calm: float = 0.05) -> DataFrame:
    """Longest run of stable rows, or the calmest rows when no run is long enough."""
    rows = settle(clean_score_steps(series))
    cut = global_quantiles(rows, {"cutoff": ("score", quantile)})
    rows = beside(rows, cut).withColumn("stable", (F.col("score") <= F.col("cutoff")) & (F.col("step_bad") <= calm))
    df = Lane(rows, [], ["ts"]).numbered("_p").runs("stable", "_r").done()
    length = F.when(F.col("stable"), F.col("_r_length")).otherwise(F.lit(0))
    df = settle(df.withColumn("run_length", length.cast("long")))
    best = df.agg(
        F.min(F.struct((-F.col("run_length")).alias("l"), F.col("_r_start").alias("a"))).alias("b"),
        F.least(F.greatest(F.lit(min_rows), F.floor(F.count(F.lit(1)) * F.lit(0.10))), F.count(F.lit(1))).alias("_k"),
    ).select((-F.col("b.l")).alias("_longest"), F.col("b.a").alias("_from"), "_k")
    df = smallest_k(beside(df, best), "score", F.col("_k"), "_low")
    clean = F.when(
        F.col("_longest") >= min_rows, F.col("stable") & (F.col("_r_start") == F.col("_from"))
    ).otherwise(F.col("_low"))
    return df.select("ts", "level_bad", "step_bad", "score", "cutoff", "stable", "run_length", clean.alias("clean"))
