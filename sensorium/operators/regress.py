"""Linear models per target tag on its peers, fitted from sums of products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorium.operators.pairs import both_ways, pearson
from sensorium.plans.attach import attach
from sensorium.plans.gram import gram
from sensorium.series import Series
from sensorium.session import settle


def correlation_peers(pairs: DataFrame, most: int = 5, min_abs: float | None = None) -> DataFrame:
    """Peers of each target by |r|: those of at least ``min_abs``, or the best ones when none reaches it."""
    d = both_ways(pairs.select("tag_a", "tag_b", "r")).where(F.col("r").isNotNull())
    d = d.withColumnsRenamed({"tag_a": "target", "tag_b": "peer"}).withColumn("_a", F.round(F.abs("r"), 10))
    order = Window.partitionBy("target").orderBy(F.desc("_a"), "peer")
    d = d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    if min_abs is not None:
        d = d.withColumn("_best", F.max("_a").over(Window.partitionBy("target")))
        d = d.where((F.col("_a") >= min_abs) | (F.col("_best") < min_abs))
    return d.select("target", "peer", "rank", "r")


def design_rows(series: Series, peers: DataFrame, most: int, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """One row per (target, ts): own reading ``y`` and the readings of its peers as ``x1..``.

    Each reading is sent to the targets that use it, so the shuffle carries about
    ``most`` + 1 times the readings and no timestamp or tag gathers in one task.
    """
    x = attach(
        series.df.select("ts", F.col("tag").alias("peer"), "value"),
        settle(peers.select("target", "peer", "rank")),
        "peer",
        series.tags * most,
        "inner",
    ).select("ts", "target", "rank", F.col("value").alias("x"), F.lit(None).cast("double").alias("y"))
    y = series.df.select(
        "ts", F.col("tag").alias("target"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("x"), F.col("value").alias("y")
    )
    cells = [F.max(F.when(F.col("rank") == k, F.col("x"))).alias(f"x{k}") for k in range(1, most + 1)]
    both = y.unionByName(x)
    wide = both.groupBy("target", "ts").agg(F.max("y").alias("y"), *cells, F.max(F.when(F.col("rank") == 0, 1)).alias("_own"))
    return wide.where("_own = 1").drop("_own")


def fit(design: DataFrame, peers: DataFrame, most: int, alpha: float, penalize_intercept: bool, standardize: bool, min_rows: int = 10) -> DataFrame:
    """Ridge coefficients per target: ``target, w array<double>, train_rows, r2``.

    ``design`` holds only training rows. Peers a target does not have are left out.
    With ``standardize`` the penalty applies to z-scored columns.
    """
    counts = peers.groupBy("target").agg(F.max("rank").alias("_k"))
    xs = [f"x{k}" for k in range(1, most + 1)]
    filled = attach(design.drop("_k"), settle(counts), "target", None, "inner")
    filled = filled.withColumns({x: F.when(F.col("_k") < i + 1, F.lit(0.0)).otherwise(F.col(x)) for i, x in enumerate(xs)})
    grams = gram(filled, ["target"], ["y", *xs]).join(counts, "target")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for target, g, k in zip(pdf["target"], pdf["g"], pdf["_k"]):
                m = np.asarray(g, float).reshape(most + 2, most + 2)
                n = m[0, 0]
                if n < min_rows:
                    continue
                mean = m[0] / n
                keep = [0, *range(2, 2 + int(k))]
                a, b = m[np.ix_(keep, keep)], m[keep, 1]
                shift, scale = np.zeros(len(keep)), np.ones(len(keep))
                if standardize:
                    c = m - n * np.outer(mean, mean)
                    shift[1:] = mean[keep[1:]]
                    std = np.sqrt(np.maximum(np.diag(c)[keep[1:]], 0) / max(n - 1, 1))
                    scale[1:] = np.where(std > 0, std, 1.0)
                    ci = c[np.ix_(keep[1:], keep[1:])] / np.outer(scale[1:], scale[1:])
                    a = np.zeros_like(a)
                    a[0, 0], a[1:, 1:] = n, ci
                    b = np.concatenate([[m[0, 1]], c[keep[1:], 1] / scale[1:]])
                eye = np.eye(len(keep))
                if not penalize_intercept:
                    eye[0, 0] = 0.0
                try:
                    w = np.linalg.solve(a + alpha * eye, b)
                except np.linalg.LinAlgError:
                    w = np.linalg.pinv(a + alpha * eye) @ b
                raw = w.copy()
                raw[1:] = w[1:] / scale[1:]
                raw[0] = w[0] - raw[1:] @ shift[1:]
                a0, b0 = m[np.ix_(keep, keep)], m[keep, 1]
                rss = m[1, 1] - 2 * raw @ b0 + raw @ a0 @ raw
                tss = m[1, 1] - m[0, 1] ** 2 / n
                full = np.zeros(most + 1)
                full[: len(raw)] = raw
                out.append((target, full, int(n), 1 - rss / tss if tss > 0 else None))
            yield pd.DataFrame(out, columns=["target", "w", "train_rows", "r2"])

    return grams.mapInPandas(solve, "target string, w array<double>, train_rows long, r2 double")


def predict(design: DataFrame, models: DataFrame, most: int, bound: int | None) -> DataFrame:
    """Add ``predicted``; null where a needed peer reading is missing."""
    df = attach(design, models, "target", bound)
    total = F.col("w")[0]
    for k in range(1, most + 1):
        w = F.col("w")[k]
        total = total + F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(f"x{k}"))
    return df.withColumn("predicted", total)


def peers_by_corr(series: Series, most: int = 5, min_abs: float | None = 0.35, rows: DataFrame | None = None) -> DataFrame:
    """Correlation peers, from marked training rows when given."""
    base = series
    if rows is not None:
        base = series.pipe(lambda d: d.join(rows.where("stable").select("ts"), "ts", "left_semi"))
    return settle(correlation_peers(pearson(base), most, min_abs))


