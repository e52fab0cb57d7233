"""Drift between the first and the last part of each tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.operators.windows import time_split
from sensorium.plans.lane import Lane
from sensorium.series import Series
from sensorium.session import settle


def kolmogorov_tail(x: Column) -> Column:
    """Asymptotic P(K > x): the alternating series, 1 below 0.2 where it has not yet moved."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def drift_metrics(series: Series, ratio: float = 0.7, split: DataFrame | None = None) -> DataFrame:
    """KS statistic and p, relative mean and std shift, flag, score and first drift time per tag."""
    marked = time_split(series, ratio) if split is None else split
    marked = settle(marked.where(F.col("value").isNotNull()).select("ts", "tag", "value", "historic"))
    old, new = F.col("historic"), ~F.col("historic")
    values = marked.groupBy("tag", "value").agg(F.count_if(old).alias("_r"), F.count_if(new).alias("_c"))
    lane = Lane(values, ["tag"], ["value"], series.tag_rows).running({"_cr": ("sum", "_r"), "_cc": ("sum", "_c")})
    x = F.col("value")
    stats = settle(
        marked.groupBy("tag").agg(
            F.count_if(old).alias("n_ref"),
            F.count_if(new).alias("n_cur"),
            *[fn(F.when(side, x)).alias(f"_{name}_{which}") for which, side in (("r", old), ("c", new)) for name, fn in (("m", F.avg), ("s", F.stddev_samp))],
        )
    )
    gap = series.attach(stats.select("tag", "n_ref", "n_cur"), lane.done())
    gap = gap.groupBy("tag").agg(F.max(F.abs(F.col("_cr") / F.col("n_ref") - F.col("_cc") / F.col("n_cur"))).alias("_ks"))
    late = series.attach(stats.select("tag", "n_ref", "_m_r", "_s_r"), marked.where(new))
    beyond = (x > F.col("_m_r") + 3 * F.col("_s_r")) | (x < F.col("_m_r") - 3 * F.col("_s_r"))
    first = late.groupBy("tag").agg(F.min(F.when((F.col("n_ref") >= 5) & beyond, F.col("ts"))).alias("first_drift_ts"))
    df = stats.join(gap, "tag", "left").join(first, "tag", "left")
    enough = (F.col("n_ref") >= 5) & (F.col("n_cur") >= 5)
    en = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    df = df.withColumns(
        {
            "ks_stat": F.when(enough, F.col("_ks")),
            "mean_shift": F.when(enough, F.abs(F.col("_m_c") - F.col("_m_r")) / (F.abs("_m_r") + 1e-6)),
            "std_shift": F.when(enough, F.abs(F.col("_s_c") - F.col("_s_r")) / (F.abs("_s_r") + 1e-6)),
        }
    )
    df = df.withColumn("p_value", kolmogorov_tail(en * F.col("ks_stat")))
    flag = (F.col("p_value") < 0.05) | (F.col("mean_shift") > 0.20) | (F.col("std_shift") > 0.20)
    zero = F.lit(0.0)
    score = F.coalesce("ks_stat", zero) + F.coalesce("mean_shift", zero) + F.coalesce("std_shift", zero)
    df = df.withColumns({"drift_flag": F.coalesce(flag, F.lit(False)), "drift_score": score})
    return df.select("tag", "n_ref", "n_cur", "ks_stat", "p_value", "mean_shift", "std_shift", "drift_flag", "drift_score", "first_drift_ts")


def drift_rank(metrics: DataFrame, nodes: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Tags by drift score, limited to graph nodes when given."""
    if nodes is not None:
        metrics = metrics.join(nodes.select("tag"), "tag", "left_semi")
    return metrics.orderBy(F.desc("drift_score"), "tag").limit(top)


def flag_then_fill(metrics: DataFrame, top: int) -> DataFrame:
    """Flagged tags first by score; the rest of the list is filled with the largest scores."""
    best = metrics.orderBy(F.desc("drift_flag"), F.desc("drift_score"), "tag").limit(top)
    return best.orderBy(F.desc("drift_score"), "tag")
