"""Window operators per tag, in time order. All go through ``Lane``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorium.functions.scalar import micros, one, yes
from sensorium.operators.stats import MAD_K, center_mad, scale_of
from sensorium.plans.lane import POS, Lane
from sensorium.series import Series
from sensorium.session import settle


# Classes besides "... Anomaly" that count as an excursion.
EXCURSIONS = ("Drift", "mild_outlier", "sudden_jump", "strong_outlier")


def median_over(column: str, spec: WindowSpec, min_periods: int) -> Column:
    """Framed exact median; null while the frame has too few values."""
    held = F.array_sort(F.collect_list(column).over(spec))

    def middle(v: Column) -> Column:
        n = F.size(v)
        return F.when(n >= max(min_periods, 1), (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)

    # bound to a name, so that the frame is gathered and sorted once
    return F.transform(F.array(held), middle)[0]


def diff(series: Series, column: str = "value", name: str = "delta") -> DataFrame:
    """Reading minus the previous reading of the tag."""
    return series.lane().rolling(1, 0, lambda w: {name: F.col(column) - F.lag(column).over(w)}).done()


def delta_z(series: Series, policy: str = "floor", eps: float = 1e-9) -> DataFrame:
    """First difference over its robust scale."""
    df = settle(diff(series))
    scales = center_mad(series, {"d": "delta"}, df).select("tag", scale_of("d", policy, eps).alias("delta_scale"))
    return series.attach(scales, df).withColumn("delta_z", F.col("delta") / F.col("delta_scale"))


def local_median_mad(
    lane: Lane, column: str, back: int, ahead: int, min_periods: int, floor: float, prefix: str
) -> Lane:
    """Rolling median and the rolling median of each row's distance to its own median."""
    dev = f"_{prefix}_dev"

    def medians(w: WindowSpec) -> dict[str, Column]:
        med = median_over(column, w.rowsBetween(-back, ahead), min_periods)
        return {f"{prefix}_median": med}

    def scales(w: WindowSpec) -> dict[str, Column]:
        mad = median_over(dev, w.rowsBetween(-back, ahead), min_periods)
        return {f"{prefix}_scale": F.when(mad.isNotNull(), F.greatest(MAD_K * mad, F.lit(floor)))}

    return lane.rolling(
        2 * back,
        2 * ahead,
        medians,
        lambda w: {dev: F.abs(F.col(column) - F.col(f"{prefix}_median"))},
        scales,
    ).map(lambda d: d.drop(dev))


def centered_median_mad(series: Series, window: int = 31, min_periods: int = 11, floor: float = 1e-9) -> DataFrame:
    half = window // 2
    lane = local_median_mad(series.lane(), "value", half, half, min_periods, floor, "local")
    z = (F.col("value") - F.col("local_median")) / F.col("local_scale")
    return lane.done().withColumn("z_local", z)


def trailing_regime_z(series: Series, window: int = 72, min_periods: int = 24, floor: float = 1e-9) -> DataFrame:
    """Reading against the trailing window that ends at it."""
    lane = local_median_mad(series.lane(), "value", window - 1, 0, min_periods, floor, "long")
    z = (F.col("value") - F.col("long_median")) / F.col("long_scale")
    return lane.done().withColumn("z_long", z)


def trend_gap_z(
    series: Series, short: int = 9, short_min: int = 4, long: int = 72, long_min: int = 24, floor: float = 1e-9
) -> DataFrame:
    """Short minus long trailing median, over the tag's robust scale of that gap."""
    lane = series.lane().rolling(
        long - 1,
        0,
        lambda w: {
            "gap": median_over("value", w.rowsBetween(-(short - 1), 0), short_min)
            - median_over("value", w.rowsBetween(-(long - 1), 0), long_min)
        },
    )
    df = settle(lane.done())
    scales = center_mad(series, {"g": "gap"}, df).select("tag", scale_of("g", "floor", floor).alias("gap_scale"))
    z = F.when(F.col("gap_scale") > floor, F.col("gap") / F.col("gap_scale"))
    return series.attach(scales, df).withColumn("z_gap", z)


def early_segment_z(series: Series, fraction: float = 0.28, min_points: int = 40, floor: float = 1e-9) -> DataFrame:
    """Reading against the median and MAD of the first part of its tag."""
    df = series.lane().numbered(POS).df
    stats = early_segment(series, df, fraction, min_points, floor)
    z = (F.col("value") - F.col("early_median")) / F.col("early_scale")
    return series.attach(stats, df).withColumn("z_early", z).drop(POS, "_one")


def early_segment(series: Series, rows: DataFrame, fraction: float = 0.28, min_points: int = 40, floor: float = 1e-9) -> DataFrame:
    """Median and MAD scale of the first part of each tag; ``rows`` are all readings with their position ``POS``."""
    sizes = series.df.groupBy("tag").agg(F.count(F.lit(1)).alias("_rows"))
    df = series.attach(sizes, rows.select("tag", "value", POS))
    first = F.least(
        F.greatest(F.lit(min_points), F.floor(F.col("_rows") * F.lit(fraction))), F.col("_rows") - 1
    )
    usable = F.col("_rows") >= min_points + 10
    df = df.withColumn("_early", F.when(usable & (F.col(POS) <= first), F.col("value")))
    stats = center_mad(series, {"e": "_early"}, df)
    scale = scale_of("e", "floor", floor)
    ok = (F.col("e_n") >= max(30, min_points // 2)) & (scale > floor)
    return stats.select(
        "tag", F.when(ok, F.col("e_center")).alias("early_median"), F.when(ok, scale).alias("early_scale")
    )


def time_rolling_mean(series: Series, days: int = 5, name: str = "smooth") -> DataFrame:
    """Mean of the readings in (t - days, t] per tag.

    A span of time can hold any number of rows, so it is taken as a difference of
    running sums: the total up to the row minus the total up to the last row at or
    before t - days. Rows of one timestamp share their mean.
    """
    span = days * 86_400_000_000
    base = series.df.withColumn("_us", micros("ts"))
    if series.lane().whole:
        spec = Window.partitionBy("tag").orderBy("_us").rangeBetween(-(span - 1), 0)
        return base.withColumn(name, F.avg("value").over(spec)).drop("_us")
    points = base.groupBy("tag", "_us").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    cum = Lane(points, ["tag"], ["_us"]).running({"_cs": ("sum", "_s"), "_cn": ("sum", "_n")}).done()
    # A total leaves the window ``days`` after its row; marks sort before rows of that time.
    marks = cum.select("tag", (F.col("_us") + span).alias("_us"), F.lit(0).alias("_k"), F.struct("_cs", "_cn").alias("_b"))
    rows = cum.select("tag", "_us", F.lit(1).alias("_k"), "_cs", "_cn")
    merged = rows.unionByName(marks, allowMissingColumns=True)
    filled = Lane(merged, ["tag"], ["_us", "_k"]).running({"_left": ("last", "_b")}).done()
    smooth = (F.col("_cs") - F.coalesce(F.col("_left._cs"), F.lit(0.0))) / (
        F.col("_cn") - F.coalesce(F.col("_left._cn"), F.lit(0))
    )
    table = filled.where("_k = 1").select("tag", "_us", smooth.alias(name))
    return base.join(table, ["tag", "_us"], "left").drop("_us")


def deviation_features(series: Series, eps: float = 1e-9) -> DataFrame:
    """Level, spike, change and volatility z of each reading (missing ones count 0)."""
    level = center_mad(series, {"l": "value"})
    level = level.select("tag", F.col("l_center").alias("_c"), scale_of("l", "std1", eps).alias("_s"))
    df = series.attach(level).withColumn("level_z", (F.col("value") - F.col("_c")) / F.col("_s"))
    lane = series.lane(df).rolling(
        3,
        3,
        lambda w: {
            "_resid": F.col("value") - median_over("value", w.rowsBetween(-2, 2), 2),
            "_change": F.col("level_z") - F.lag("level_z").over(w),
            "_vol": F.when(
                F.count("level_z").over(w.rowsBetween(-3, 3)) >= 3,
                F.stddev_samp("level_z").over(w.rowsBetween(-3, 3)),
            ),
        },
    )
    df = settle(lane.done())
    stats = center_mad(series, {"r": "_resid", "h": "_change", "v": "_vol"}, df).select(
        "tag",
        scale_of("r", "std1", eps).alias("_rs"),
        scale_of("h", "std1", eps).alias("_hs"),
        F.col("v_center").alias("_vc"),
        scale_of("v", "std1", eps).alias("_vs"),
    )
    df = series.attach(stats, df)
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "spike_z": F.coalesce(F.col("_resid") / F.col("_rs"), zero),
            "change_z": F.coalesce(F.col("_change") / F.col("_hs"), zero),
            "volatility_z": F.coalesce((F.col("_vol") - F.col("_vc")) / F.col("_vs"), zero),
        }
    )
    return df.drop("_c", "_s", "_resid", "_change", "_vol", "_rs", "_hs", "_vc", "_vs")


def flatline(lane: Lane, name: str = "flatline", window: int = 5) -> Lane:
    """True when the last ``window`` readings are all present and equal."""

    def step(w: WindowSpec) -> dict[str, Column]:
        spec = w.rowsBetween(-(window - 1), 0)
        full = F.count("value").over(spec) == window
        return {name: yes(full & (F.min("value").over(spec) == F.max("value").over(spec)))}

    return lane.rolling(window - 1, 0, step)


def jump(series: Series, df: DataFrame | None = None, k: float = 3.0) -> DataFrame:
    """True when the absolute difference exceeds k standard deviations of such differences."""
    lane = series.lane(df).rolling(1, 0, lambda w: {"_ad": F.abs(F.col("value") - F.lag("value").over(w))})
    df = lane.done()
    spread = df.groupBy("tag").agg(F.stddev_samp("_ad").alias("_sd"))
    return series.attach(spread, df).withColumn("jump", yes(F.col("_ad") > k * F.col("_sd"))).drop("_ad", "_sd")


def persist_in_window(lane: Lane, flag: str, name: str, radius: int = 1, need: int = 2) -> Lane:
    """At least ``need`` flags among the row and its neighbours."""
    total = f"{name}_count"
    return lane.rolling(
        radius,
        radius,
        lambda w: {total: F.sum(one(F.col(flag))).over(w.rowsBetween(-radius, radius)).cast("long")},
    ).map(lambda d: d.withColumn(name, F.col(total) >= need))


def neighbour_persist(lane: Lane, flag: str, name: str) -> Lane:
    """The flag counted with those of the rows before and after reaches 2."""
    hit = one(F.col(flag))
    return lane.rolling(
        1,
        1,
        lambda w: {
            name: hit + F.coalesce(F.lag(hit).over(w), F.lit(0)) + F.coalesce(F.lead(hit).over(w), F.lit(0)) >= 2
        },
    )


def isolation_downgrade(lane: Lane, fired: str, cls: str, warn: int = 2, radius: int = 2, keep_from: int = 4) -> Lane:
    """A lone Actual Outlier with few signals and no supporting neighbour becomes a Warning."""
    support = F.sum(one(F.col(fired) >= warn))
    return lane.rolling(
        radius, radius, lambda w: {"_near": support.over(w.rowsBetween(-radius, radius))}
    ).map(
        lambda d: d.withColumn(
            cls,
            F.when(
                (F.col(cls) == "Actual Outlier") & (F.col("_near") <= 1) & (F.col(fired) < keep_from), "Warning"
            ).otherwise(F.col(cls)),
        ).drop("_near")
    )


def run_length(lane: Lane, flag: str, name: str) -> Lane:
    """Length of the run of true flags each row is in, 0 where the flag is false."""
    return lane.runs(flag, "_r").map(
        lambda d: d.withColumn(name, F.when(F.col(flag), F.col("_r_length")).otherwise(F.lit(0)).cast("long")).drop(
            "_r_length", "_r_start", "_r_end"
        )
    )


def rolling_baseline(series: Series, window: int = 30, k: float = 3.0, expanding: bool = False) -> DataFrame:
    """Mean, population std, z and limits from the rows before each row; first rows are skipped."""
    lane = series.lane().numbered("_at")
    if expanding:
        # Totals of shifted values: stable sums without holding the rows.
        shift = series.df.groupBy("tag").agg(F.avg("value").alias("_m"))
        lane = lane.map(lambda d: series.attach(shift, d).withColumn("_x", F.col("value") - F.col("_m")))
        lane = lane.map(lambda d: d.withColumn("_xx", F.col("_x") * F.col("_x")))
        lane = lane.running({"_n": ("count", "_x"), "_s": ("sum", "_x"), "_ss": ("sum", "_xx")})
        own = F.when(F.col("_x").isNotNull(), 1).otherwise(0)
        n = F.col("_n") - own
        s = F.col("_s") - F.coalesce(F.col("_x"), F.lit(0.0))
        ss = F.col("_ss") - F.coalesce(F.col("_xx"), F.lit(0.0))
        lane = lane.map(
            lambda d: d.withColumns(
                {
                    "baseline_mean": F.when(n > 0, s / n + F.col("_m")),
                    "baseline_std": F.when(n > 1, F.sqrt(F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0)))),
                }
            ).drop("_m", "_x", "_xx", "_n", "_s", "_ss")
        )
    else:
        lane = lane.rolling(
            window,
            0,
            lambda w: {
                "baseline_mean": F.avg("value").over(w.rowsBetween(-window, -1)),
                "baseline_std": F.when(
                    F.count("value").over(w.rowsBetween(-window, -1)) > 1,
                    F.stddev_pop("value").over(w.rowsBetween(-window, -1)),
                ),
            },
        )
    mean, std = F.col("baseline_mean"), F.col("baseline_std")
    return (
        lane.done()
        .where(F.col("_at") > window)
        .withColumns(
            {
                "z_score": F.when(std > 0, (F.col("value") - mean) / std),
                "lower_limit": mean - k * std,
                "upper_limit": mean + k * std,
            }
        )
        .drop("_at")
    )


def ewma_prev(series: Series, span: float = 12.0, column: str = "value", name: str = "ewma_prev") -> DataFrame:
    """Exponentially weighted mean of the rows before each row; null before the first reading.

    A missing reading keeps the mean, and makes earlier ones count less once the next comes. Every reading is an
    affine map of the mean so far, and maps compose: blocks of readings, each long enough to forget what came
    before the block ahead of it, are folded apart and then chained, so a tag may be spread over any number of tasks.
    """
    keep = 1.0 - 2.0 / (span + 1.0)
    if not 0.0 < keep < 1.0:
        raise ValueError("span has to be above 1")
    # after so many readings less than 1e-37 of a mean is left
    block = min(max(int(-85.0 / math.log(keep)) + 1, 2), 2**31 - 1)
    rows = series.lane().numbered("_at").done()
    rows = settle(rows)
    seen = rows.where(F.col(column).isNotNull()).select("tag", "_at", F.col(column).alias("_x"))
    lane = Lane(seen, ["tag"], ["_at"], series.tag_rows).rolling(1, 0, lambda w: {"_last": F.lag("_at").over(w)}).numbered("_no")
    old = F.pow(F.lit(keep), F.col("_at") - F.col("_last"))
    # mean = a * mean before + b; the first reading is the mean
    maps = lane.done().select(
        "tag",
        "_at",
        F.floor((F.col("_no") - 1) / block).alias("_blk"),
        F.coalesce(F.log(old / (old + 1 - keep)), F.lit(0.0)).alias("_la"),
        F.coalesce((1 - keep) / (old + 1 - keep), F.lit(1.0)).alias("_w"),
        "_x",
    )
    inside = Window.partitionBy("tag", "_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("_pa", F.sum("_la").over(inside))
    maps = maps.withColumn("_b", F.exp("_pa") * F.sum(F.col("_w") * F.col("_x") * F.exp(-F.col("_pa"))).over(inside))
    maps = settle(maps.select("tag", "_at", "_blk", F.exp("_pa").alias("_a"), "_b"))
    ends = maps.groupBy("tag", "_blk").agg(F.max_by(F.struct("_a", "_b"), "_at").alias("_e"))
    ahead = Window.partitionBy("tag").orderBy("_blk")
    ends = ends.withColumns({"_e1": F.lag("_e", 1).over(ahead), "_e2": F.lag("_e", 2).over(ahead)})
    carry = F.coalesce(F.col("_e1._b"), F.lit(0.0)) + F.coalesce(F.col("_e1._a") * F.col("_e2._b"), F.lit(0.0))
    means = maps.join(ends.select("tag", "_blk", carry.alias("_carry")), ["tag", "_blk"])
    means = means.select("tag", "_at", (F.col("_a") * F.col("_carry") + F.col("_b")).alias("_mean"))
    joined = rows.join(means, ["tag", "_at"], "left")
    out = series.lane(joined).running({"_so_far": ("last", "_mean")}).rolling(1, 0, lambda w: {name: F.lag("_so_far").over(w)})
    return out.done().drop("_at", "_mean", "_so_far")


def lag_features(series: Series, lags: int = 3) -> DataFrame:
    """Value and its first lags side by side."""
    return (
        series.lane()
        .rolling(lags, 0, lambda w: {f"lag{k}": F.lag("value", k).over(w) for k in range(1, lags + 1)})
        .done()
    )


def rolling_features(series: Series, short: int = 9, long: int = 31) -> DataFrame:
    """Model inputs per reading: rolling moments, differences, residual, calendar and an early flag."""

    def step(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for size in (short, long):
            spec = w.rowsBetween(-(size - 1), 0)
            enough = F.count("value").over(spec) >= max(3, size // 3)
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                out[f"{name}_{size}"] = F.when(enough, fn("value").over(spec))
        out["diff"] = F.col("value") - F.lag("value").over(w)
        return out

    sizes = series.df.groupBy("tag").agg(F.count(F.lit(1)).alias("_rows"))
    lane = series.lane().numbered("_at").rolling(long - 1, 0, step)
    df = series.attach(sizes, lane.done())
    return df.withColumns(
        {
            "abs_diff": F.abs("diff"),
            f"resid_{long}": F.col("value") - F.col(f"mean_{long}"),
            "hour": F.hour("ts"),
            "weekday": F.weekday("ts"),
            "early": F.col("_at") <= F.greatest(F.lit(10), F.floor(F.col("_rows") * F.lit(0.28))),
        }
    ).drop("_at", "_rows")


def time_split(series: Series, ratio: float = 0.7) -> DataFrame:
    """Mark the first ``floor(ratio · n)`` rows of each tag as historic."""
    sizes = series.df.groupBy("tag").agg(F.count(F.lit(1)).alias("_rows"))
    df = series.attach(sizes, series.lane().numbered("_at").done())
    return df.withColumn("historic", F.col("_at") <= F.floor(F.col("_rows") * F.lit(ratio))).drop("_at", "_rows")


def every_kth(series: Series, target: int = 8000) -> DataFrame:
    """Systematic sample of about ``target`` rows per tag."""
    sizes = series.df.groupBy("tag").agg(F.count(F.lit(1)).alias("_rows"))
    df = series.attach(sizes, series.lane().numbered("_at").done())
    stride = F.greatest(F.floor(F.col("_rows") / target), F.lit(1))
    return df.where((F.col("_at") - 1) % stride == 0).drop("_at", "_rows")


def spike_relabel(series: Series, df: DataFrame, persistence: int = 2, cls: str = "final_class") -> DataFrame:
    """Abnormal runs of at most ``persistence`` rows are marked as spikes that returned to normal."""
    bad = yes(F.col(cls).contains("Anomaly") | F.col(cls).isin(*EXCURSIONS))
    lane = run_length(series.lane(df.withColumn("_bad", bad)), "_bad", "_len")
    short = F.col("_len").between(1, max(1, persistence))
    return lane.done().withColumn(cls, F.when(short, "Spike - Returned Normal").otherwise(F.col(cls))).drop("_bad", "_len")


def rank_tags(df: DataFrame, score: str, name: str = "rank_order") -> DataFrame:
    """Rank rows of a per-tag table by score, ties by tag name."""
    return Lane(df.withColumn("_neg", -F.col(score)), [], ["_neg", "tag"]).numbered(name).done().drop("_neg")
