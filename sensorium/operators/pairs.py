"""Statistics of pairs of tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.operators.stats import global_quantiles
from sensorium.plans.attach import beside
from sensorium.plans.gram import HIST_BLOCK, gram, pair_histograms, pair_information, pair_moments, tag_ids
from sensorium.plans.lane import Lane
from sensorium.series import Series
from sensorium.session import settle


def _spread(n: str, s: str, ss: str) -> Column:
    return F.greatest(F.col(ss) - F.col(s) * F.col(s) / F.col(n), F.lit(0.0))


def moment_corr(need: int = 3, zero_fill: bool = True) -> Column:
    """Pearson r from moments; too few rows or no spread give 0 (or null)."""
    va, vb = _spread("n", "sa", "saa"), _spread("n", "sb", "sbb")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    flat = (F.sqrt(va / (F.col("n") - 1)) < 1e-12) | (F.sqrt(vb / (F.col("n") - 1)) < 1e-12)
    r = cov / F.sqrt(va * vb)
    r = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
    none = F.lit(0.0) if zero_fill else F.lit(None).cast("double")
    return F.when((F.col("n") < need) | flat, none).otherwise(r)


def pearson(series: Series, need: int = 3, zero_fill: bool = True) -> DataFrame:
    """r of every pair of tags on common timestamps: ``tag_a < tag_b, n, r``."""
    m = pair_moments(series)
    return m.select("tag_a", "tag_b", F.col("n").cast("long").alias("n"), moment_corr(need, zero_fill).alias("r"))


def average_ranks(series: Series) -> Series:
    """Values replaced by their average rank inside the tag."""
    counted = series.df.where(F.col("value").isNotNull()).groupBy("tag", "value").agg(F.count(F.lit(1)).alias("_w"))
    lane = Lane(counted, ["tag"], ["value"], series.tag_rows).running({"_cum": ("sum", "_w")})
    ranks = lane.done().select("tag", "value", (F.col("_cum") - (F.col("_w") - 1) / 2).alias("rank"))
    df = series.df.join(ranks, ["tag", "value"]).drop("value").withColumnRenamed("rank", "value")
    return series.like(df)


def spearman(series: Series) -> DataFrame:
    """Pearson r of average ranks."""
    return pearson(average_ranks(series)).withColumnRenamed("r", "rho")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once per direction."""
    rest = [c for c in pairs.columns if c not in ("tag_a", "tag_b")]
    swapped = pairs.select(F.col("tag_b").alias("tag_a"), F.col("tag_a").alias("tag_b"), *rest)
    return pairs.unionByName(swapped)


def lag_corr(series: Series, max_lag: int = 5, need: int = 10) -> DataFrame:
    """Best |r| of each target with a source 1..max_lag rows earlier (the smallest lag on ties)."""
    m = pair_moments(series, max_lag).where("lag > 0")
    scored = m.where(F.col("n") >= need).select("tag_a", "tag_b", "lag", moment_corr().alias("r"))
    best = scored.groupBy("tag_a", "tag_b").agg(
        F.min(F.struct((-F.round(F.abs("r"), 12)).alias("s"), "lag", "r")).alias("_b")
    )
    return best.select(
        F.col("tag_a").alias("target"), F.col("tag_b").alias("source"), F.col("_b.lag").alias("best_lag"), F.col("_b.r").alias("lag_r")
    )


def cross_corr(series: Series, max_lag: int = 7, need: int = 30) -> DataFrame:
    """Best |r| over lags -max..max for each directed pair, with the lag-0 value.

    A positive lag means the source moved first. Negative lags of a pair are the
    positive lags of the reversed pair, so only non-negative lags are computed.
    """
    m = settle(pair_moments(series, max_lag))
    r = moment_corr(2, zero_fill=False)
    ahead = m.where("lag > 0").select(F.col("tag_a").alias("target"), F.col("tag_b").alias("source"), "lag", "n", r.alias("r"))
    behind = m.where("lag > 0").select(F.col("tag_b").alias("target"), F.col("tag_a").alias("source"), (-F.col("lag")).alias("lag"), "n", r.alias("r"))
    now = m.where("lag = 0").select("tag_a", "tag_b", "lag", "n", r.alias("r"))
    now = both_ways(now).withColumnsRenamed({"tag_a": "target", "tag_b": "source"})
    every = now.unionByName(ahead).unionByName(behind)
    usable = (F.col("n") >= need) & F.col("r").isNotNull()
    pick = F.struct((-F.round(F.abs("r"), 12)).alias("s"), "lag", "r")
    best = every.groupBy("target", "source").agg(
        F.min(F.when(usable, pick)).alias("_b"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("_z")
    )
    return best.select(
        "target",
        "source",
        F.coalesce("_b.r", F.lit(0.0)).alias("best_r"),
        F.coalesce("_b.lag", F.lit(0)).alias("best_lag"),
        F.coalesce("_z", F.lit(0.0)).alias("zero_lag_r"),
    )


def hist_mutual_info(series: Series, bins: int = 14, need: int = 40) -> DataFrame:
    """Mutual information in nats of equal-width histograms, and its share of the 95 % quantile."""
    ids = tag_ids(series)
    keys = ["tag_a", "tag_b"]
    if series.tags > HIST_BLOCK:
        every = pair_information(series, ids, bins)
    else:
        counts = settle(pair_histograms(series, ids, bins))
        rows = counts.groupBy(*keys, "ka").agg(F.sum("n").alias("na"))
        cols = counts.groupBy(*keys, "kb").agg(F.sum("n").alias("nb"))
        total = counts.groupBy(*keys).agg(F.sum("n").alias("nt"))
        cells = counts.join(rows, [*keys, "ka"]).join(cols, [*keys, "kb"]).join(total, keys)
        term = F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb")))
        every = cells.groupBy(*keys).agg(F.sum(term).alias("mi"), F.max("nt").alias("n"))
    mi = settle(every.select(*keys, F.when(F.col("n") >= need, F.greatest(F.col("mi"), F.lit(0.0))).otherwise(0.0).alias("mi")))
    high = global_quantiles(mi, {"_hi": ("mi", 0.95)})
    df = beside(mi, high)
    return df.withColumn("mi_norm", F.least(F.lit(1.0), F.col("mi") / F.when(F.col("_hi") > 0, F.col("_hi")).otherwise(1.0))).drop("_hi")


def f_regression(series: Series) -> DataFrame:
    """Univariate F of a linear fit from r and n, both directions alike."""
    p = pearson(series)
    f = F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2)
    return p.withColumn("f", F.when(F.abs("r") < 1, f))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    from math import exp, lgamma, log

    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x)) / a
    tiny = 1e-300
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) of an F law."""
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def granger(series: Series, pairs: DataFrame, max_lag: int = 7, need: int | None = None, scale: float = 10.0) -> DataFrame:
    """Smallest p of the F tests that the lags 1..k of ``source`` help to predict ``target``.

    Only the listed ``target, source`` pairs are tested. The tests need nothing but sums
    of products, which each task adds up before the shuffle.
    """
    need = max_lag + 15 if need is None else need
    mean = series.df.where(F.col("value").isNotNull()).groupBy("ts", "tag").agg(F.avg("value").alias("value"))
    own = mean.select("ts", F.col("tag").alias("target"), F.col("value").alias("y"))
    other = mean.select("ts", F.col("tag").alias("source"), F.col("value").alias("x"))
    rows = own.join(pairs.select("target", "source"), "target").join(other, ["ts", "source"])
    # a lag is an earlier row of the pair, both readings present
    earlier = lambda w: {f"{c}_lag{k}": F.lag(c, k).over(w) for c in ("y", "x") for k in range(1, max_lag + 1)}
    rows = settle(Lane(rows, ["target", "source"], ["ts"], series.tag_rows).rolling(max_lag, 0, earlier).done())
    grams = None
    for k in range(1, max_lag + 1):
        cols = ["y", *[f"y_lag{j}" for j in range(1, k + 1)], *[f"x_lag{j}" for j in range(1, k + 1)]]
        part = gram(rows, ["target", "source"], cols).withColumn("k", F.lit(k))
        grams = part if grams is None else grams.unionByName(part)
    sizes = rows.groupBy("target", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("y").alias("ny"), F.count_distinct("x").alias("nx")
    )

    def test(frames):
        for pdf in frames:
            out = []
            for target, source, g, k in zip(pdf["target"], pdf["source"], pdf["g"], pdf["k"]):
                m = np.asarray(g, float).reshape(2 * k + 2, 2 * k + 2)
                n = m[0, 0]

                def rss(index: list[int]) -> float:
                    a, b = m[np.ix_(index, index)], m[index, 1]
                    w, *_ = np.linalg.lstsq(a, b, rcond=None)
                    return float(m[1, 1] - 2 * w @ b + w @ a @ w)

                small = rss([0, *range(2, 2 + k)])
                full = rss([0, *range(2, 2 + 2 * k)])
                left = n - (2 * k + 1)
                p = 1.0
                if left > 0 and full > 0:
                    p = f_tail((small - full) / k / (full / left), k, left)
                out.append((target, source, int(k), p))
            yield pd.DataFrame(out, columns=["target", "source", "k", "p"])

    tests = grams.mapInPandas(test, "target string, source string, k int, p double")
    best = tests.groupBy("target", "source").agg(F.min(F.struct("p", "k")).alias("_b"))
    df = best.join(sizes, ["target", "source"]).where((F.col("rows") >= need) & (F.col("ny") >= 3) & (F.col("nx") >= 3))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.log10(F.col("_b.p") + 1e-12) / scale))
    return df.select("target", "source", F.col("_b.p").alias("p"), F.col("_b.k").alias("granger_lag"), strength.alias("granger_strength"))


def tag_relationships(
    series: Series, max_lag: int = 7, top_k: int = 7, min_score: float = 0.38, need: int = 60
) -> DataFrame:
    """Directed relationship table: cross correlation, mutual information, Granger strength, score, choice."""
    cc = cross_corr(series, max_lag)
    mi = both_ways(hist_mutual_info(series)).withColumnsRenamed({"tag_a": "target", "tag_b": "source"})
    pre = cc.join(mi, ["target", "source"], "left").fillna(0.0, ["mi", "mi_norm"])
    pre = settle(pre.withColumn("prelim", 0.68 * F.abs("best_r") + 0.32 * F.col("mi_norm")))
    order = Window.partitionBy("target").orderBy(F.desc("prelim"), "source")
    ranked = pre.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(6, top_k + 2))
    chosen = ranked.where((F.col("prelim") >= 0.20) | (F.abs("best_r") >= 0.20)).select("target", "source")
    tests = granger(series, settle(chosen), max_lag, max(need, max_lag * 15), 5.0)
    df = pre.join(tests, ["target", "source"], "left").fillna({"p": 1.0, "granger_lag": 0, "granger_strength": 0.0})
    score = 0.50 * F.abs("best_r") + 0.25 * F.col("mi_norm") + 0.25 * F.col("granger_strength")
    df = df.withColumn("score", score).withColumn("sign", F.when(F.col("best_r") >= 0, 1).otherwise(-1))
    best = Window.partitionBy("target").orderBy(F.desc("score"), "source")
    df = df.withColumn("_rank", F.row_number().over(best))
    enough = F.sum(F.when(F.col("score") >= min_score, 1).otherwise(0)).over(Window.partitionBy("target"))
    pick = (F.col("_rank") <= top_k) & ((F.col("score") >= min_score) | (F.least(enough, F.lit(top_k)) < min(3, top_k)))
    return df.withColumn("selected", pick).drop("_rank")
