"""Peer regression with five-way classes, and the fusion of three detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.functions.classes import LADDER, binary_status, ladder_name, ladder_rank
from sensorium.functions.scalar import one, range_position, yes
from sensorium.operators import regress
from sensorium.operators.clean import stable_rows
from sensorium.operators.pairs import pearson
from sensorium.operators.stats import center_mad, scale_of
from sensorium.series import Series
from sensorium.session import settle

EPS = 1e-9

# One sentence per class.
EXPLANATIONS = {
    "Normal": "Actual is consistent with predicted value from top correlated tags.",
    "Drift": "Actual is outside historical value range, but related tags support the shift.",
    "Contextual Anomaly": "Within-limit outlier: value may be inside limits, but residual against predicted value is abnormal.",
    "Drift + Anomaly": "Value is outside historical range and also breaks relationship with top correlated tags.",
    "Strong Anomaly": "Extreme residual/range break against top correlated feature model.",
}


def top5_regression(series: Series, peers_n: int = 5, need: int = 80) -> DataFrame:
    """Ridge on the most correlated tags over stable rows; residual, range and peer shift decide the class."""
    rows = settle(stable_rows(series))
    stable = series.pipe(lambda d: d.join(rows.where("stable").select("ts"), "ts", "left_semi"))
    peers = settle(regress.correlation_peers(pearson(stable, 2, zero_fill=False), peers_n))
    df = series.df.join(rows.select("ts", "stable"), "ts", "left")
    own = center_mad(series, {"v": "value"}).select(
        "tag", F.col("v_center").alias("_oc"), scale_of("v", "std1", EPS).alias("_os")
    )
    df = series.attach(own, df)
    df = df.withColumn("_calm", yes(F.abs((F.col("value") - F.col("_oc")) / F.col("_os")) <= 3.5))
    present = F.col("value").isNotNull()
    counts = df.groupBy("tag").agg(
        F.count_if(F.col("stable") & present).alias("_n1"), F.count_if(F.col("_calm") & present).alias("_n2")
    )
    df = series.attach(counts, df)
    train = F.when(F.col("_n1") >= need, F.col("stable")).when(F.col("_n2") >= 20, F.col("_calm")).otherwise(True)
    train = F.when((F.col("_n1") >= need) & (F.col("_n1") < 20), True).otherwise(train)
    df = settle(df.select("ts", "row_index", "tag", "value", (train & present).alias("_train")))
    trained = df.withColumn("_t", F.when(F.col("_train"), F.col("value")))
    probs = {"p01": ("_t", 0.01), "p05": ("_t", 0.05), "p95": ("_t", 0.95), "p99": ("_t", 0.99), "_med": ("_t", 0.5)}
    ref = center_mad(series, {"t": "_t"}, trained, probs)
    ref = settle(ref.select("tag", F.col("t_center").alias("_tc"), scale_of("t", "std1", EPS).alias("_ts"), "p01", "p05", "p95", "p99"))

    # Peers without a reading take their median over the training rows of the target.
    design = regress.design_rows(series, peers, peers_n)
    flags = df.select(F.col("tag").alias("target"), "ts", "_train")
    design = settle(design.join(flags, ["target", "ts"]).join(peers.groupBy("target").agg(F.max("rank").alias("_k")), "target"))
    by_tag = design.withColumnRenamed("target", "tag")
    by_tag = by_tag.withColumns({f"_t{i}": F.when(F.col("_train"), F.col(f"x{i}")) for i in range(1, peers_n + 1)})
    stats = center_mad(series, {f"f{i}": f"_t{i}" for i in range(1, peers_n + 1)}, by_tag)
    picks = [
        piece
        for i in range(1, peers_n + 1)
        for piece in (F.col(f"f{i}_center").alias(f"_c{i}"), scale_of(f"f{i}", "std1", EPS).alias(f"_s{i}"))
    ]
    by_tag = series.attach(stats.select("tag", *picks), by_tag)
    shifts = [one(F.abs((F.col(f"x{i}") - F.col(f"_c{i}")) / F.col(f"_s{i}")) > 2.5) for i in range(1, peers_n + 1)]
    by_tag = by_tag.withColumn("group_support", sum(shifts, F.lit(0)))
    by_tag = by_tag.withColumn("peer_shift", F.col("group_support") / F.col("_k"))
    by_tag = by_tag.withColumns({f"x{i}": F.coalesce(f"x{i}", f"_c{i}") for i in range(1, peers_n + 1)})
    design = by_tag.withColumnRenamed("tag", "target")
    models = settle(regress.fit(design.where("_train"), peers, peers_n, 1.0, False, True))
    scored = regress.predict(design, models, peers_n, series.tags)
    scored = settle(
        scored.select(
            F.col("target").alias("tag"), "ts", "y", "predicted", (F.col("y") - F.col("predicted")).alias("residual"), "_train", "group_support", "peer_shift", "r2"
        )
    )
    train_res = scored.withColumn("_r", F.when(F.col("_train"), F.col("residual")))
    res = center_mad(series, {"r": "_r"}, train_res).select(
        "tag", F.col("r_center").alias("_rc"), scale_of("r", "std1", EPS).alias("_rs")
    )
    out = series.attach(ref, series.attach(res, scored)).withColumnRenamed("y", "value")
    x = F.col("value")
    out = out.withColumns(
        {
            "value_z": (x - F.col("_tc")) / F.col("_ts"),
            "residual_z": (F.col("residual") - F.col("_rc")) / F.col("_rs"),
            "soft_flag": yes((x < F.col("p05")) | (x > F.col("p95"))),
            "outer_flag": yes((x < F.col("p01")) | (x > F.col("p99"))),
            "range_position": range_position(x, F.col("p01"), F.col("p05"), F.col("p95"), F.col("p99")),
        }
    )
    return contextual_classes(out).drop("_train", "_rc", "_rs", "_tc", "_ts")


def contextual_classes(df: DataFrame) -> DataFrame:
    """Five-way class, status, severity and explanation from z values, range flags and peer shift."""
    vz = F.coalesce(F.abs("value_z"), F.lit(0.0))
    rz = F.coalesce(F.abs("residual_z"), F.lit(0.0))
    soft, outer = F.col("soft_flag"), F.col("outer_flag")
    odd = rz >= 4.0
    final = (
        F.when((rz >= 7.0) | (outer & odd) | ((vz >= 4.5) & odd), "Strong Anomaly")
        .when(soft & odd, "Drift + Anomaly")
        .when(odd, "Contextual Anomaly")
        .when(soft, "Drift")
        .otherwise("Normal")
    )
    score = 12 * rz + 8 * vz + 20 * F.coalesce("peer_shift", F.lit(0.0)) + one(outer) * 15 + one(soft) * 8
    df = df.withColumns({"final_class": final, "severity": F.round(F.least(F.lit(100.0), score), 1)})
    text = F.create_map(*[F.lit(v) for pair in EXPLANATIONS.items() for v in pair])
    return df.withColumns(
        {"final_status": binary_status("final_class"), "explanation": F.try_element_at(text, F.col("final_class"))}
    )


def fuse_join(auto: DataFrame, inside: DataFrame, model: DataFrame) -> DataFrame:
    """Full outer join of three results on (ts, tag); the first known value wins, a missing class is Normal."""
    parts = []
    for i, d in enumerate((auto, inside, model)):
        parts.append(d.select("ts", "tag", F.col("value").alias(f"_v{i}"), F.col("final_class").alias(f"class_{i + 1}")))
    df = parts[0].join(parts[1], ["ts", "tag"], "full_outer").join(parts[2], ["ts", "tag"], "full_outer")
    return df.select(
        "ts",
        "tag",
        F.coalesce("_v0", "_v1", "_v2").alias("value"),
        *[F.coalesce(f"class_{i}", F.lit("Normal")).alias(f"class_{i}") for i in (1, 2, 3)],
    )


def fuse_labels(df: DataFrame) -> DataFrame:
    """Most severe of three classes, with the engines that reached it."""
    known = {f"class_{i}": F.when(F.col(f"class_{i}").isin(*LADDER), F.col(f"class_{i}")).otherwise("Normal") for i in (1, 2, 3)}
    df = df.withColumns(known)
    ranks = [ladder_rank(f"class_{i}") for i in (1, 2, 3)]
    top = F.greatest(*ranks)
    labels = ("clean_limits", "inside_range", "regression")
    drivers = F.array_compact(
        F.array(*[F.when(r == top, F.concat(F.lit(f"{n}="), F.col(f"class_{i + 1}"))) for i, (r, n) in enumerate(zip(ranks, labels))])
    )
    fused = ladder_name(top)
    text = F.concat(
        F.lit("Fusion=max_severity("),
        F.concat_ws("|", "class_1", "class_2", "class_3"),
        F.lit(")->"),
        fused,
        F.lit("; drivers: "),
        F.array_join(drivers, ", "),
    )
    return df.withColumns({"final_class": fused, "drivers": drivers, "rationale": text})


def detect_fused(auto: DataFrame, inside: DataFrame, model: DataFrame) -> DataFrame:
    return fuse_labels(fuse_join(auto, inside, model))
