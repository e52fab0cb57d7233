"""Multi-signal consensus: eight tests per reading, a vote, and an isolation rule."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions.classes import CONSENSUS_TO_LADDER, lookup
from sensorium.functions.scalar import one, yes
from sensorium.operators import models, regress
from sensorium.operators.limits import consensus_baseline
from sensorium.operators.stats import MAD_K, center_mad, scale_of
from sensorium.operators.windows import early_segment, isolation_downgrade
from sensorium.plans.frames import Held, framed_median, nothing
from sensorium.plans.lane import POS, Lane
from sensorium.series import Series
from sensorium.session import settle

SIGNALS = ("S1_GLOBAL", "S2_LOCAL", "S3_TUKEY", "S4_DIFF", "S5_PEER", "S6_LONG", "S7_TREND", "S8_EARLY")


@dataclass(frozen=True)
class ConsensusConfig:
    """Thresholds of the vote; the defaults are the conservative five-signal setting."""

    k_global: float = 4.0
    k_local: float = 4.0
    k_fence: float = 3.0
    k_diff: float = 5.0
    k_peer: float = 4.0
    local_window: int = 31
    local_min: int = 11
    max_peers: int = 5
    min_abs_corr: float = 0.35
    ridge_alpha: float = 1.0
    n_actual: int = 3
    n_actual_strict: int = 4
    n_warning: int = 2
    radius: int = 2
    isolation_keep: int = 4
    trim: float = 0.0
    long_window: int = 0
    long_min: int = 20
    k_long: float = 3.5
    short_window: int = 9
    short_min: int = 4
    k_gap: float = 3.0
    early_share: float = 0.0
    early_min: int = 40
    k_early: float = 3.0
    k_early_strong: float = 999.0
    min_mad: float = 1e-9
    use_peers: bool = True
    dynamic_peers: bool = True


CONSERVATIVE = ConsensusConfig()
# The eight-signal preset.
MULTI_SIGNAL = ConsensusConfig(
    k_global=3.75,
    k_local=3.75,
    k_fence=2.75,
    k_diff=4.5,
    k_peer=3.75,
    min_abs_corr=0.30,
    n_actual_strict=3,
    trim=0.15,
    long_window=72,
    long_min=24,
    k_long=3.15,
    k_gap=2.85,
    early_share=0.28,
    k_early=2.95,
    k_early_strong=3.55,
)

# Rows of a block whose framed medians are taken at once, and whose votes are judged at once.
FRAME_ROWS = 200_000
CONTROL_FIELDS = "tag string, threshold double, engines array<string>, direction string"


def long_sizes(cfg: ConsensusConfig, n: int) -> tuple[int, int, int, int]:
    """Window lengths and minimum counts of S6 and S7 for a tag of n rows (all 0 when too short)."""
    if cfg.long_window <= 0 or n < max(25, cfg.long_window // 2):
        return 0, 0, 0, 0
    long = min(cfg.long_window, max(30, n - 1))
    long_min = min(cfg.long_min, max(10, long // 3))
    short = min(min(cfg.short_window, max(5, long // 4)), max(5, long - 1))
    return long, long_min, short, min(cfg.short_min, max(3, short - 2))


def windowed_values(series: Series, cfg: ConsensusConfig) -> DataFrame:
    """The columns of ``windowed_lane`` for every reading."""
    return windowed_lane(series, cfg).done()


def windowed_lane(series: Series, cfg: ConsensusConfig) -> Lane:
    """Step, local median and scale, long median and scale, and trend gap in one ordered pass.

    Tags of more than ``FRAME_ROWS`` rows are cut into blocks, so that the pass has tasks for all cores.
    Their rows keep their position, so that later passes need not be ordered again.
    """
    half = cfg.local_window // 2
    full = cfg.long_window
    lane = Lane(series.df, ["tag"], ["ts", "row_index"], series.tag_rows, FRAME_ROWS)
    if full:
        # shorter tags get shorter windows
        sizes = series.df.groupBy("tag").agg(F.count(F.lit(1)).alias("_rows"))
        lane = lane.map(lambda d: series.attach(sizes, d))

    def step(rows: pa.Table) -> dict[str, pa.Array]:
        x = Held.of(rows.column("value"))
        near = framed_median(x, half, half, cfg.local_min)
        out = {"_delta": x - x.before(), "_lm": near, "_ls": framed_median(abs(x - near), half, half, cfg.local_min)}
        if full:
            # a table without the count of its tag (a null tag) reads as a long one
            count = rows.column("_rows")[0].as_py()
            long, long_min, short, short_min = long_sizes(cfg, full + 1 if count is None else min(count, full + 1))
            far = brief = scale = nothing(len(x.value))
            if long:
                far, brief = framed_median(x, long - 1, 0, long_min), framed_median(x, short - 1, 0, short_min)
                scale = framed_median(abs(x - far), long - 1, 0, long_min)
            out |= {"_tm": far, "_sm": brief, "_gap": brief - far, "_ts": scale}
        return {name: held.arrow() for name, held in out.items()}

    fields = ["_delta", "_lm", "_ls", *(["_tm", "_sm", "_gap", "_ts"] if full else [])]
    lane = lane.rolling_arrow(max(2 * half, 2 * full), 2 * half, step, fields)
    return lane.map(lambda d: d.drop("_rows"))


def consensus_peers(series: Series, cfg: ConsensusConfig) -> DataFrame:
    """``target, peer, rank`` by several scores and a forest, or by correlation alone; gaps count as medians."""
    if cfg.dynamic_peers:
        return settle(models.dynamic_peers(series, cfg.max_peers, cfg.min_abs_corr))
    return settle(regress.correlation_peers(models.filled_pearson(series), cfg.max_peers, cfg.min_abs_corr))


def peer_residual_z(series: Series, z_global: DataFrame, cfg: ConsensusConfig, peers: DataFrame | None = None) -> DataFrame:
    """``tag, ts, predicted, z_peer`` from a ridge on each tag's peers, trained on its calm rows."""
    k = cfg.max_peers
    peers = consensus_peers(series, cfg) if peers is None else peers
    design = regress.design_rows(series, peers, k)
    design = settle(
        design.join(z_global.select(F.col("tag").alias("target"), "ts", "z_global"), ["target", "ts"], "left").join(
            peers.groupBy("target").agg(F.max("rank").alias("_k")), "target"
        )
    )
    whole = F.col("y").isNotNull()
    for i in range(1, k + 1):
        whole = whole & ((F.col("_k") < i) | F.col(f"x{i}").isNotNull())
    calm = whole & (F.coalesce(F.abs("z_global"), F.lit(0.0)) < cfg.k_global)
    design = design.withColumns({"_whole": whole, "_calm": calm})
    sizes = settle(
        design.groupBy("target").agg(
            F.count_if("_whole").alias("_nw"), F.count_if("_calm").alias("_nc"), F.max("_k").alias("_kk")
        )
    )
    design = design.join(F.broadcast(sizes) if series.tags <= 100_000 else sizes, "target")
    few = F.col("_nc") < F.greatest(F.lit(30), F.col("_kk") * 5)
    design = design.withColumn("_train", F.when(few, F.col("_whole")).otherwise(F.col("_calm")) & (F.col("_nw") >= 30))
    fitted = settle(regress.fit(design.where("_train"), peers, k, cfg.ridge_alpha, True, False))
    scored = regress.predict(design, fitted, k, series.tags)
    scored = scored.withColumn("_res", F.col("y") - F.col("predicted")).withColumn(
        "_tr", F.when(F.col("_train"), F.col("_res"))
    )
    by_tag = scored.withColumnRenamed("target", "tag")
    scale = center_mad(series, {"r": "_tr"}, by_tag).select("tag", scale_of("r", "floor", cfg.min_mad).alias("_rs"))
    z = F.when(F.col("_rs") > cfg.min_mad, F.col("_res") / F.col("_rs"))
    return series.attach(scale, by_tag).select("tag", "ts", "predicted", z.alias("z_peer"))


def signal_values(series: Series, cfg: ConsensusConfig, peer: DataFrame | None = None) -> DataFrame:
    """All z values and fences per reading.

    ``peer`` may bring another model's ``predicted, z_peer``; tags that it does not name get the ridge on their peers.
    Readings of tags that were cut into blocks also have their position ``POS``.
    """
    # several passes read the framed values; they are taken once
    framed = settle(windowed_lane(series, cfg).df)
    steps = framed.select("tag", "value", F.col("_delta").alias("delta"))
    base = settle(consensus_baseline(series, cfg.trim, None, min_mad=cfg.min_mad, steps=steps))
    df = series.attach(base, framed)
    x = F.col("value")
    ok = F.col("mad_scale") > cfg.min_mad
    local = F.when(F.col("_ls").isNotNull(), F.greatest(MAD_K * F.col("_ls"), F.lit(cfg.min_mad)))
    none = F.lit(None).cast("double")
    df = df.withColumns(
        {
            "z_global": F.when(ok, (x - F.col("median")) / F.col("mad_scale")),
            "z_local": (x - F.col("_lm")) / local,
            "_local_ok": yes(local > cfg.min_mad),
            "z_diff": F.when(F.col("diff_scale") > cfg.min_mad, F.col("_delta") / F.col("diff_scale")),
            "off_state": F.col("off_mode") & yes(F.abs("value") <= F.col("off_floor")),
        }
    )
    if cfg.long_window:
        scale = F.when(F.col("_ts").isNotNull(), F.greatest(MAD_K * F.col("_ts"), F.lit(cfg.min_mad)))
        df = df.withColumn("z_long", (x - F.col("_tm")) / scale)
        gaps = center_mad(series, {"g": "_gap"}, df).select("tag", scale_of("g", "floor", cfg.min_mad).alias("_gs"))
        df = series.attach(gaps, df)
        df = df.withColumn("z_gap", F.when(F.col("_gs") > cfg.min_mad, F.col("_gap") / F.col("_gs")))
    else:
        df = df.withColumns({"z_long": none, "z_gap": none})
    if cfg.early_share > 0:
        rows = framed if POS in framed.columns else series.lane().numbered(POS).df
        early = early_segment(series, rows, cfg.early_share, cfg.early_min, cfg.min_mad)
        stats = early.withColumnsRenamed({"early_median": "_em", "early_scale": "_es"})
        df = series.attach(stats, df).withColumn("z_early", (x - F.col("_em")) / F.col("_es"))
    else:
        df = df.withColumn("z_early", none)
    if cfg.use_peers:
        named = None if peer is None else settle(peer.select("tag").distinct())
        if named is None or named.count() < series.tags:
            df = settle(df)
            plain = peer_residual_z(series, df, cfg)
            peer = plain if peer is None else peer.unionByName(plain.join(named, "tag", "left_anti"))
    if peer is None:
        df = df.withColumns({"predicted": none, "z_peer": none})
    else:
        df = df.join(peer.select("tag", "ts", "predicted", "z_peer"), ["tag", "ts"], "left")
    return df.withColumn("predicted", F.coalesce("predicted", "median")).drop(
        "_delta", "_lm", "_ls", "_tm", "_sm", "_ts", "_gap", "_gs", "_em", "_es"
    )


def vote(series: Series, values: DataFrame, cfg: ConsensusConfig, controls: DataFrame | None = None) -> DataFrame:
    """Fire flags, counts and classes. ``controls`` (one row per tag) scales thresholds, picks engines and a direction."""
    df = values
    if controls is not None:
        # worked out per tag, so that each reading only meets flags
        way, named = F.lower(F.coalesce("direction", F.lit("both"))), F.when(F.size("engines") > 0, F.col("engines"))
        flags = {
            "_named": F.lit(True),
            "_ratio": F.coalesce(F.when(F.col("threshold") > 0, F.col("threshold") / cfg.k_global), F.lit(1.0)),
            "_up": way.isin("up", "upward", "u"),
            "_down": way.isin("down", "downward", "d"),
        }
        flags |= {f"_on_{name}": named.isNull() | F.array_contains(named, name) for name in SIGNALS}
        df = series.attach(controls.select("tag", *[c.alias(n) for n, c in flags.items()]), df)
        df = df.withColumn("_ratio", F.coalesce("_ratio", F.lit(1.0)))
    else:
        df = df.withColumns({"_ratio": F.lit(1.0), "_up": F.lit(False), "_down": F.lit(False)})
    ratio, x = F.col("_ratio"), F.col("value")
    awake = ~F.col("off_state")
    df = df.withColumns(
        {
            "fence_lower": F.when(F.col("iqr") > 0, F.col("q1") - cfg.k_fence * ratio * F.col("iqr")),
            "fence_upper": F.when(F.col("iqr") > 0, F.col("q3") + cfg.k_fence * ratio * F.col("iqr")),
        }
    )
    up, down = F.col("_up"), F.col("_down")

    def side(z: Column) -> Column:
        return F.when(up, z > 0).when(down, z < 0).otherwise(True)

    def on(engine: str) -> Column:
        return F.lit(True) if controls is None else F.when(F.col("_named"), F.col(f"_on_{engine}")).otherwise(True)

    tests = {
        "S1_GLOBAL": ("z_global", cfg.k_global),
        "S2_LOCAL": ("z_local", cfg.k_local),
        "S4_DIFF": ("z_diff", cfg.k_diff),
        "S5_PEER": ("z_peer", cfg.k_peer),
        "S6_LONG": ("z_long", cfg.k_long),
        "S7_TREND": ("z_gap", cfg.k_gap),
        "S8_EARLY": ("z_early", cfg.k_early),
    }
    fires = {
        f"fire_{name.lower()}": yes((F.abs(z) >= k * ratio) & side(F.col(z))) & awake & on(name)
        for name, (z, k) in tests.items()
    }
    above, below = yes(x > F.col("fence_upper")), yes(x < F.col("fence_lower"))
    outside = F.when(up, above).when(down, below).otherwise(above | below)
    fires["fire_s3_tukey"] = outside & awake & on("S3_TUKEY")
    strong = F.lit(False)
    if cfg.k_early_strong < 100 and cfg.early_share > 0:
        # The strong early test is judged on the scaled threshold too, and drops out beyond 100.
        reach = cfg.k_early_strong * ratio
        strong = yes((F.abs("z_early") >= reach) & (reach < 100) & side(F.col("z_early"))) & awake & on("S8_EARLY")
    fires["fire_s8_early_strong"] = strong
    df = df.withColumns(fires)
    fired = sum((one(F.col(c)) for c in fires), F.lit(0))
    testable = (
        one((F.col("mad_scale") > cfg.min_mad) & on("S1_GLOBAL"))
        + one(F.col("_local_ok") & on("S2_LOCAL"))
        + one((F.col("iqr") > 0) & on("S3_TUKEY"))
        + one((F.col("diff_scale") > cfg.min_mad) & on("S4_DIFF"))
        + one(F.col("z_peer").isNotNull() & on("S5_PEER"))
        + one(F.col("z_long").isNotNull() & on("S6_LONG"))
        + one(F.col("z_gap").isNotNull() & on("S7_TREND"))
        + one(F.col("_early_ok") & on("S8_EARLY"))
    )
    early = values.groupBy("tag").agg((F.count("z_early") > 0).alias("_early_ok"))
    df = series.attach(early, df)
    df = df.withColumns({"signals_fired": fired.cast("long"), "signals_testable": testable.cast("long")})
    n = F.col("signals_fired")
    actual = (F.col("fire_s5_peer") & (n >= cfg.n_actual)) | (n >= cfg.n_actual_strict)
    first = (
        F.when(F.col("off_state"), "Normal")
        .when(actual, "Actual Outlier")
        .when(n >= cfg.n_warning, "Warning")
        .otherwise("Normal")
    )
    df = df.withColumn("final_class", first)
    lane = Lane.placed(df, ["tag"], ["ts", "row_index"], series.tag_rows, FRAME_ROWS) if POS in df.columns else series.lane(df)
    lane = isolation_downgrade(lane, "signals_fired", "final_class", cfg.n_warning, cfg.radius, cfg.isolation_keep)
    df = lane.done()
    return df.withColumns(
        {
            "plot_class": lookup("final_class", CONSENSUS_TO_LADDER, "Normal"),
            "direction": F.when(x >= F.col("median"), "High").when(x < F.col("median"), "Low").otherwise("Low"),
            "limit_crossed": F.when(F.coalesce(~(above | below), F.lit(False)), "Within_Limits").otherwise("Outer_Range"),
        }
    ).drop("_ratio", "_up", "_down", "_named", "_early_ok", "_local_ok", *[f"_on_{name}" for name in SIGNALS])


def consensus(
    series: Series,
    cfg: ConsensusConfig = CONSERVATIVE,
    controls: DataFrame | None = None,
    peer: DataFrame | None = None,
) -> DataFrame:
    """Score, vote and classify every reading."""
    return vote(series, settle(signal_values(series, cfg, peer)), cfg, controls)


@dataclass(frozen=True)
class ModelConfig:
    """How models for the peer signal are chosen."""

    max_peers: int = 10
    min_abs_corr: float = 0.15
    folds: int = 3
    least_rows: int = 60


def multimodel(series: Series, cfg: ConsensusConfig = MULTI_SIGNAL, how: ModelConfig = ModelConfig(), controls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vote with every tag's winning model as its peer signal, and the winners.

    Tags without a model (too few rows, no peers) keep the ridge on their peers.
    """
    peers = settle(models.dynamic_peers(series, how.max_peers, how.min_abs_corr))
    winners = models.train_winners(series, peers, how.folds, how.least_rows)
    signal = settle(models.peer_signal(series, peers, winners))
    return consensus(series, cfg, controls, signal), winners


def reason_text(df: DataFrame, cfg: ConsensusConfig) -> DataFrame:
    """Add ``reason``: which z values passed the configured limits, the fence, and the signal count."""
    checks = [("z_global", "global z", cfg.k_global), ("z_local", "local z", cfg.k_local), ("z_diff", "diff z", cfg.k_diff), ("z_peer", "peer z", cfg.k_peer)]
    if cfg.long_window:
        checks += [("z_long", "long-regime z", cfg.k_long), ("z_gap", "trend-gap z", cfg.k_gap)]
    if cfg.early_share > 0:
        checks.append(("z_early", "early-segment z", cfg.k_early))
    parts = [
        F.when(F.abs(z) >= k, F.format_string(f"{label}=%.2f>={k:.1f}", F.abs(z))) for z, label, k in checks
    ]
    if cfg.k_early_strong < 100 and cfg.early_share > 0:
        ks = cfg.k_early_strong
        parts.append(F.when(F.abs("z_early") >= ks, F.format_string(f"early-segment strong z=%.2f>={ks:.2f}", F.abs("z_early"))))
    parts.append(F.when(F.col("fire_s3_tukey"), "outside IQR fence"))
    found = F.array_compact(F.array(*parts))
    text = F.when(F.size(found) == 0, "Within consensus limits").otherwise(F.array_join(found, "; "))
    count = F.format_string("  (signals=%d)", F.col("signals_fired"))
    return df.withColumn("reason", F.concat(text, count))


def without_peers(cfg: ConsensusConfig) -> ConsensusConfig:
    """The same vote with the peer signal left untested."""
    return replace(cfg, use_peers=False)


def frozen_limits(series: Series, cfg: ConsensusConfig = MULTI_SIGNAL) -> DataFrame:
    """The per-tag baseline as a table to keep for later scoring."""
    return consensus_baseline(series, cfg.trim, None, min_mad=cfg.min_mad)


__all__ = [
    "CONSERVATIVE",
    "MULTI_SIGNAL",
    "ConsensusConfig",
    "ModelConfig",
    "consensus",
    "consensus_peers",
    "frozen_limits",
    "multimodel",
    "peer_residual_z",
    "reason_text",
    "signal_values",
    "vote",
    "without_peers",
]
