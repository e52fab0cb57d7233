"""Clean periods, clusters of related tags, and detectors that judge a tag by its cluster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.functions.scalar import blend_z, clip, one, signed_abs_z, weighted_median, yes
from sensorium.operators import regress
from sensorium.operators.clean import bad_shares
from sensorium.operators.pairs import both_ways, pearson, tag_relationships
from sensorium.operators.report import keep_best_duplicate, top_n_per_group
from sensorium.operators.stats import center_mad, global_quantiles, reference_profile, scale_of
from sensorium.operators.windows import diff, neighbour_persist, run_length
from sensorium.plans.attach import attach, beside
from sensorium.plans.gram import pair_moments
from sensorium.plans.lane import Lane
from sensorium.series import Series
from sensorium.session import settle

EPS = 1e-9


# -- clean periods -----------------------------------------------------------------


def _global_z(series: Series, df: DataFrame | None = None, column: str = "value", name: str = "z") -> DataFrame:
    stats = center_mad(series, {"g": column}, df)
    table = stats.select("tag", F.col("g_center").alias("_gc"), scale_of("g", "std1", EPS).alias("_gs"))
    out = series.attach(table, df)
    return out.withColumn(name, (F.col(column) - F.col("_gc")) / F.col("_gs")).drop("_gc", "_gs")


def row_quantile_scores(series: Series, limit: float, weight: float) -> tuple[DataFrame, DataFrame]:
    """Per timestamp: share of tags beyond the limit, median and P90 of |z|, and their score; also the readings with z."""
    z = settle(_global_z(series).select("ts", "tag", "row_index", "value", "z"))
    bad = bad_shares(series, z, {"bad_fraction": F.abs("z") > limit})
    mids = z.groupBy("ts").agg(F.percentile(F.abs("z"), F.array(F.lit(0.5), F.lit(0.9))).alias("_q"))
    rows = bad.join(mids, "ts").select("ts", "bad_fraction", F.col("_q")[0].alias("median_abs_z"), F.col("_q")[1].alias("p90_abs_z"))
    score = F.col("median_abs_z") + 0.6 * F.col("p90_abs_z") + weight * F.col("bad_fraction")
    return settle(Lane(rows.withColumn("score", score), [], ["ts"]).numbered("pos").done()), z


def contiguous_candidates(series: Series, need: int = 360) -> DataFrame:
    """Best long run of clean rows; without one, the calmest block of that length: ``ts, clean, ...``."""
    rows, _ = row_quantile_scores(series, 2.8, 2.5)
    cut = global_quantiles(rows, {"_cut": ("score", 0.45)})
    rows = beside(rows, cut)
    rows = rows.withColumn("candidate", (F.col("bad_fraction") <= 0.12) & (F.col("score") <= F.col("_cut"))).drop("_cut")
    runs = settle(Lane(rows, [], ["ts"]).runs("candidate", "_r").done())
    good = runs.where(F.col("candidate") & (F.col("_r_length") >= need)).groupBy("_r_start", "_r_end").agg(
        F.avg("score").alias("_s"), F.avg("bad_fraction").alias("_b"), F.max("_r_length").alias("_l")
    )
    rank = F.struct((F.col("_s") + 3.0 * F.col("_b") - 0.002 * F.col("_l")).alias("k"), F.col("_b").alias("b"), (-F.col("_l")).alias("l"), F.col("_r_start").alias("a"), F.col("_r_end").alias("z"))
    best = good.agg(F.min(rank).alias("b")).select("b.a", "b.z").first()
    if best is None or best["a"] is None:
        n = rows.count()
        width = min(max(need, 60), n)
        means = window_means(rows, ["score", "bad_fraction"], width)
        metric = F.round(F.col("m_score") + 5 * F.col("m_bad_fraction"), 9)
        choice = F.struct((F.col("m_bad_fraction") > 0.16).alias("over"), metric.alias("m"), F.col("pos").alias("z"))
        end = means.where("m_score IS NOT NULL").agg(F.min(choice).alias("b")).select("b.z").first()["z"]
        best = {"a": end - width + 1, "z": end}
    return runs.select("ts", "bad_fraction", "median_abs_z", "p90_abs_z", "score", "candidate", F.col("pos").between(best["a"], best["z"]).alias("clean"))


def window_means(rows: DataFrame, columns: Sequence[str], width: int) -> DataFrame:
    """Means of the last ``width`` rows at each position, by running sums (null before there are enough)."""
    lane = Lane(rows, [], ["ts"]).running({f"_c_{c}": ("sum", c) for c in columns})
    df = settle(lane.done().select("pos", *[f"_c_{c}" for c in columns]))
    left = df.select((F.col("pos") + width).alias("pos"), *[F.col(f"_c_{c}").alias(f"_l_{c}") for c in columns])
    df = df.join(left, "pos", "left")
    full = F.col("pos") >= width
    return df.select("pos", *[F.when(full, (F.col(f"_c_{c}") - F.coalesce(f"_l_{c}", F.lit(0.0))) / width).alias(f"m_{c}") for c in columns])


def stepped_windows(series: Series, sizes: Sequence[int] = (120, 180, 240), step: int = 7) -> DataFrame:
    """Calmest of many windows, judged on score, spread, trend and bad share: ``ts, clean, ...``.

    Spread and trend of every tag in every window come from running sums of z, z² and
    position·z, looked up at both ends of the window.
    """
    rows, z = row_quantile_scores(series, 3.0, 5.0)
    n = rows.count()
    sizes = sorted({w for w in sizes if 30 <= w <= n} | ({min(240, n)} if n >= 30 else set()))
    if not sizes:
        raise ValueError(f"a window needs 30 timestamps, there are {n}")
    z = z.join(rows.select("ts", "pos"), "ts").withColumn("_z", F.coalesce("z", F.lit(0.0)))
    z = z.withColumns({"_zz": F.col("_z") * F.col("_z"), "_tz": F.col("_z") * F.col("pos")})
    lane = Lane(z, ["tag"], ["pos", "row_index"], series.tag_rows)
    sums = lane.running({"_a": ("sum", "_z"), "_b": ("sum", "_zz"), "_c": ("sum", "_tz")}).done()
    sums = settle(sums.select("tag", "pos", "_a", "_b", "_c"))
    starts = F.explode(F.array(*[F.lit(w) for w in sizes])).alias("w")
    ends = sums.select("tag", F.col("pos").alias("end"), "_a", "_b", "_c", starts)
    ends = ends.where((F.col("end") >= F.col("w")) & ((F.col("end") - F.col("w")) % step == 0))
    before = sums.select("tag", F.col("pos").alias("_from"), F.col("_a").alias("_a0"), F.col("_b").alias("_b0"), F.col("_c").alias("_c0"))
    spans = ends.withColumn("_from", F.col("end") - F.col("w")).join(before, ["tag", "_from"], "left")
    w = F.col("w").cast("double")
    s, ss, ts = (F.col(c) - F.coalesce(f"{c}0", F.lit(0.0)) for c in ("_a", "_b", "_c"))
    var = F.greatest(ss - s * s / w, F.lit(0.0))
    mid = F.col("end") - (w - 1) / 2
    cov = ts - mid * s
    spread_t = (w * w - 1) * w / 12
    trend = F.when(F.sqrt(var / w) < 1e-9, 0.0).otherwise(F.abs(cov) / F.sqrt(var * spread_t))
    per_tag = spans.select("w", "end", trend.alias("_trend"), F.sqrt(var / (w - 1)).alias("_std"))
    judged = per_tag.groupBy("w", "end").agg(F.median("_trend").alias("trend"), F.median("_std").alias("spread"))
    parts = None
    for size in sizes:
        m = window_means(rows, ["score", "bad_fraction"], size).withColumnRenamed("pos", "end").withColumn("w", F.lit(size))
        parts = m if parts is None else parts.unionByName(m)
    judged = judged.join(parts, ["w", "end"])
    rank = F.col("m_score") + 2.0 * F.col("spread") + 1.5 * F.col("trend") + 3.0 * F.col("m_bad_fraction")
    pick = F.struct(F.round(rank, 9).alias("k"), F.round("m_bad_fraction", 9).alias("b"), F.round("spread", 9).alias("s"), "w", "end")
    best = judged.agg(F.min(pick).alias("b")).select("b.w", "b.end").first()
    clean = F.col("pos").between(best["end"] - best["w"] + 1, best["end"])
    return rows.select("ts", "bad_fraction", "median_abs_z", "p90_abs_z", "score", clean.alias("clean"))


def consistency_window(series: Series, width: int = 180) -> DataFrame:
    """Calmest 180 rows by 1·level + 0.5·spike share + 0.02·median |z| (shorter sizes for short data)."""
    df = _global_z(series, settle(diff(series)))
    df = settle(_global_z(series, df, "delta", "dz"))
    rows = bad_shares(series, df, {"level": F.abs("z") > 3.5, "spike": F.abs("dz") > 4.0}).join(
        df.groupBy("ts").agg(F.median(F.abs("z")).alias("mid")), "ts"
    )
    rows = rows.withColumn("score", F.col("level") + 0.5 * F.col("spike") + 0.02 * F.coalesce("mid", F.lit(0.0)))
    rows = settle(Lane(rows, [], ["ts"]).numbered("pos").done())
    n = rows.count()
    tries = [width] if n >= width else [w for w in (150, 120, 90, 60, 45, 30, 25, 20, 15, 10, 8, 6, 5, 4, 3, 2) if w <= n]
    best = None
    for w in tries if n >= width else [n, *tries]:
        m = window_means(rows, ["score"], w).where("m_score IS NOT NULL")
        got = m.agg(F.min(F.struct(F.round("m_score", 9).alias("s"), F.col("pos").alias("p"))).alias("b")).select("b.s", "b.p").first()
        if best is None or got["s"] < best[0]:
            best = (got["s"], w, got["p"])
    _, w, end = best
    return rows.select("ts", "level", "spike", "score", F.col("pos").between(end - w + 1, end).alias("clean"))


def relation_window(series: Series, sizes: Sequence[int] = (112, 150, 202), step: int = 10) -> DataFrame:
    """Calmest of stepped windows by mean, P90, bad and spike share of the row score."""
    df = _global_z(series, settle(diff(series)))
    df = settle(_global_z(series, df, "delta", "dz"))
    rows = bad_shares(
        series, df, {"bad": F.abs("z") > 3.2, "extreme": F.abs("z") > 4.2, "spike": F.abs("dz") > 3.2, "present": F.col("value").isNotNull()}
    )
    score = 0.55 * F.col("bad") + 0.20 * F.col("extreme") + 0.20 * F.col("spike") + 0.05 * (1 - F.col("present"))
    rows = settle(Lane(rows.withColumn("score", score), [], ["ts"]).numbered("pos").done())
    n = rows.count()
    # A row lies in at most size/step windows of each size.
    parts = None
    for w in [w for w in sizes if w <= n]:
        first = F.greatest(F.lit(0), F.ceil((F.col("pos") - w) / step))
        last = F.least(F.floor((F.col("pos") - 1) / step), F.lit((n - w) // step))
        m = rows.where(first <= last).select(F.explode(F.sequence(first, last)).alias("k"), "score", "bad", "spike").withColumn("w", F.lit(w))
        parts = m if parts is None else parts.unionByName(m)
    if parts is None:
        raise ValueError(f"no window of {min(sizes)} rows fits into {n} rows")
    judged = parts.groupBy("w", "k").agg(
        F.avg("score").alias("s"), F.percentile("score", F.lit(0.9)).alias("p"), F.avg("bad").alias("b"), F.avg("spike").alias("d")
    )
    rank = F.col("s") + 0.20 * F.col("p") + 0.10 * F.col("b") + 0.05 * F.col("d") - 0.00005 * F.col("w")
    pick = F.struct(F.round(rank, 9).alias("r"), F.round("b", 9).alias("b"), F.round("d", 9).alias("d"), "w", "k")
    best = judged.agg(F.min(pick).alias("b")).select("b.w", "b.k").first()
    start = best["k"] * step + 1
    return rows.select("ts", "score", F.col("pos").between(start, start + best["w"] - 1).alias("clean"))


def clean_part(series: Series, rows: DataFrame) -> Series:
    keep = rows.where("clean").select("ts")
    return series.like(settle(series.df.join(keep, "ts", "left_semi")))


# -- clusters ------------------------------------------------------------------------


def components(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected component of each tag, named by its smallest tag, by repeated neighbour minima."""
    ways = settle(edges.select("tag_a", "tag_b").unionByName(edges.select(F.col("tag_b").alias("tag_a"), F.col("tag_a").alias("tag_b"))))
    labels = settle(tags.select("tag", F.col("tag").alias("label")))
    while True:
        near = ways.join(labels, F.col("tag_b") == F.col("tag")).groupBy("tag_a").agg(F.min("label").alias("_near"))
        step = labels.join(near, F.col("tag") == F.col("tag_a"), "left").select(
            "tag", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("label")
        )
        # Pointer jumping: take over the label of the own label.
        jump = step.join(labels.select(F.col("tag").alias("_t"), F.col("label").alias("_ll")), F.col("label") == F.col("_t"))
        step = settle(jump.select("tag", "_old", F.least("label", "_ll").alias("label")))
        labels = step.drop("_old")
        if not step.where("_old <> label").limit(1).count():
            return labels


def corr_clusters(series: Series, threshold: float = 0.58, min_size: int = 3, peers: int = 6) -> tuple[DataFrame, DataFrame]:
    """Members ``cluster_id, tag, is_primary`` and pair correlations.

    Components of strong correlation form clusters; every other tag gets a cluster with
    its best peers. A tag's primary cluster is the first that holds it.
    """
    tags = settle(series.df.select("tag").distinct())
    corr = settle(pearson(series, 2).select("tag_a", "tag_b", F.col("r")))
    comps = components(tags, corr.where(F.abs("r") >= threshold))
    sizes = comps.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    order = Lane(sizes.withColumn("_neg", -F.col("_n")), [], ["_neg", "label"]).numbered("num").done()
    big = comps.join(order.select("label", "num"), "label").select("num", "tag")
    taken = order.agg(F.count(F.lit(1)).alias("_k"))
    lone = tags.join(big.select("tag"), "tag", "left_anti")
    lone = beside(Lane(lone, [], ["tag"]).numbered("_i").done(), taken).select((F.col("_i") + F.col("_k")).alias("num"), "tag")
    ranked = both_ways(corr).withColumn("_a", F.round(F.abs("r"), 10))
    best = top_n_per_group(ranked, ["tag_a"], [F.desc("_a"), F.col("tag_b")], peers)
    extra = lone.join(best, lone.tag == best.tag_a).select("num", F.col("tag_b").alias("tag"))
    members = settle(big.unionByName(lone).unionByName(extra).distinct())
    first = F.min("num").over(Window.partitionBy("tag"))
    name = F.format_string("Cluster_%02d", F.col("num"))
    return members.withColumn("is_primary", F.col("num") == first).select(name.alias("cluster_id"), "tag", "is_primary"), corr


def cluster_table(members: DataFrame, corr: DataFrame) -> DataFrame:
    """Size and mean |r| of each cluster."""
    a = members.select("cluster_id", F.col("tag").alias("tag_a"))
    b = members.select("cluster_id", F.col("tag").alias("tag_b"))
    inner = corr.join(a, "tag_a").join(b, ["cluster_id", "tag_b"]).groupBy("cluster_id").agg(F.avg(F.abs("r")).alias("avg_abs_r"))
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).join(inner, "cluster_id", "left")


def strong_groups(tags: DataFrame, corr: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Groups of tags joined by |r| of at least ``threshold``, numbered by their smallest tag."""
    labels = components(tags, corr.where(F.abs("r") >= threshold))
    order = Lane(labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), [], ["label"]).numbered("group_id").done()
    return labels.join(order.select("label", "group_id"), "label").select("tag", "group_id")


def relation_communities(tags: DataFrame, rel: DataFrame, edge: float = 0.44, most: int = 10, attach_at: float = 0.38) -> DataFrame:
    """Components of the best relations, cut to at most ``most`` tags; singles join their best group."""
    pair = rel.select(F.least("target", "source").alias("tag_a"), F.greatest("target", "source").alias("tag_b"), "score", F.abs("best_r").alias("r"))
    pair = settle(pair.groupBy("tag_a", "tag_b").agg(F.max("score").alias("score"), F.max_by("r", "score").alias("r")))
    ways = both_ways(pair)
    top = top_n_per_group(ways, ["tag_a"], [F.desc("score"), F.col("tag_b")], 5)
    labels = settle(components(tags, top.where((F.col("score") >= edge) | (F.col("r") >= 0.55))))
    inside = ways.join(labels.select(F.col("tag").alias("tag_a"), F.col("label").alias("_la")), "tag_a")
    inside = inside.join(labels.select(F.col("tag").alias("tag_b"), F.col("label").alias("_lb")), "tag_b").where("_la = _lb")
    means = inside.groupBy(F.col("tag_a").alias("tag")).agg(F.avg("score").alias("_m"))
    ranked = labels.join(means, "tag", "left").withColumn("_neg", -F.coalesce("_m", F.lit(0.0)))
    lane = Lane(ranked, ["label"], ["_neg", "tag"]).numbered("_i")
    groups = lane.done().select("tag", F.concat_ws("/", "label", F.floor((F.col("_i") - 1) / most)).alias("grp"))
    groups = settle(groups)
    sizes = settle(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")))
    singles = groups.join(sizes.where("_n = 1"), "grp").select("tag")
    homes = groups.join(sizes.where("_n > 1"), "grp").select(F.col("tag").alias("tag_b"), "grp", F.col("_n"))
    offers = ways.join(singles.select(F.col("tag").alias("tag_a")), "tag_a").join(homes, "tag_b").where(F.col("score") >= attach_at)
    best = top_n_per_group(offers, ["tag_a"], [F.desc("score"), F.col("grp")], 1)
    # a group takes its best singles up to the limit; the others stay alone
    turn = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "tag_a"))
    moved = best.withColumn("_turn", turn).where(F.col("_n") + F.col("_turn") <= most).select(F.col("tag_a").alias("tag"), F.col("grp").alias("_to"))
    out = groups.join(moved, "tag", "left").select("tag", F.coalesce("_to", "grp").alias("grp"))
    ids = out.groupBy("grp").agg(F.min("tag").alias("_f"))
    ids = Lane(ids, [], ["_f"]).numbered("_g").done()
    return out.join(ids, "grp").select(F.format_string("G%02d", F.col("_g")).alias("cluster_id"), "tag")


# -- peers of a reading -----------------------------------------------------------------


def peer_rows(z: DataFrame, peers: DataFrame, tags: int, most: int) -> DataFrame:
    """One row per (target, pos): the signed z of its peers (``lag`` rows earlier) with weights, as short arrays."""
    links = settle(peers.select("target", F.col("peer").alias("tag"), "sign", "weight", "lag", "rank"))
    sent = attach(z.select("tag", "pos", "z"), links, "tag", tags * most, "inner")
    cell = F.struct("rank", (F.col("z") * F.col("sign")).alias("v"), F.col("weight").alias("w"))
    got = sent.groupBy("target", (F.col("pos") + F.col("lag")).alias("pos")).agg(F.sort_array(F.collect_list(cell)).alias("peers"))
    return got.withColumnRenamed("target", "tag")


def _share(cells: str, test) -> Column:
    n = F.size(cells)
    return F.when(n > 0, F.size(F.filter(cells, test)) / n).otherwise(0.0)


# -- detectors ---------------------------------------------------------------------------


def cluster_zscore(series: Series) -> DataFrame:
    """Tag z against the median of its sign-adjusted cluster peers, with support and isolation rules."""
    clean = clean_part(series, contiguous_candidates(series))
    ref = reference_profile(series, clean.df)
    members, corr = corr_clusters(clean, 0.55, 3, 2)
    mine = members.where("is_primary").select("cluster_id", "tag")
    mates = members.select("cluster_id", F.col("tag").alias("peer"))
    links = mine.join(mates, "cluster_id").where("tag <> peer")
    links = links.join(both_ways(corr), (F.col("tag") == F.col("tag_a")) & (F.col("peer") == F.col("tag_b")))
    links = links.select(F.col("tag").alias("target"), "peer", "r", F.round(F.abs("r"), 10).alias("_a"))
    order = Window.partitionBy("target").orderBy(F.desc("_a"), "peer")
    links = links.withColumn("rank", F.row_number().over(order)).where("rank <= 8")
    sign = F.when(F.col("r") >= 0, 1.0).otherwise(-1.0)
    links = settle(links.select("target", "peer", sign.alias("sign"), F.lit(1.0).alias("weight"), F.lit(0).alias("lag"), "rank"))
    std = F.when(F.col("std") > EPS, F.col("std")).otherwise(EPS)
    table = ref.select("tag", F.col("mean").alias("_m"), std.alias("_s"), F.col("median").alias("_c"), F.when(F.col("mad_scale") > EPS, F.col("mad_scale")).otherwise(std).alias("_k"))
    pos = settle(Lane(series.df.select("ts").distinct(), [], ["ts"]).numbered("pos").done())
    df = series.attach(table, series.df.join(pos, "ts"))
    df = df.withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s"))
    df = df.withColumn("tag_abs_z", F.least(F.abs("z"), F.abs((F.col("value") - F.col("_c")) / F.col("_k"))))
    df = settle(df.select("ts", "row_index", "tag", "value", "pos", "z", "tag_abs_z"))
    # The clean reference of the residual uses the plain peer median.
    plain = peer_rows(df, links.withColumn("sign", F.lit(1.0)), series.tags, 8)
    plain = plain.withColumn("_pm", _array_median("peers"))
    base = df.join(plain.select("tag", "pos", "_pm"), ["tag", "pos"], "left")
    base = base.join(clean.df.select("ts", "tag"), ["ts", "tag"], "left_semi")
    base = base.withColumn("_res", F.col("z") - F.coalesce("_pm", F.lit(0.0)))
    res = center_mad(series, {"r": "_res"}, base)
    res = res.select("tag", F.col("r_center").alias("_rc"), F.greatest(F.coalesce("r_std", F.lit(EPS)), scale_of("r", "std1", EPS), F.lit(EPS)).alias("_rs"))
    res = res.withColumn("_rs", F.when(F.col("_rs") > EPS, F.col("_rs")).otherwise(1.0))
    signed = peer_rows(df, links, series.tags, 8)
    df = df.join(signed, ["tag", "pos"], "left").withColumn("peers", F.coalesce("peers", F.array().cast(signed.schema["peers"].dataType)))
    df = series.attach(res, df)
    z = F.col("z")
    moved = lambda p: F.abs(p["v"]) >= 1.0
    df = df.withColumns(
        {
            "residual_z": (z - F.coalesce(_array_median("peers"), F.lit(0.0)) - F.col("_rc")) / F.col("_rs"),
            "peer_high": _share("peers", lambda p: F.abs(p["v"]) >= 2.0),
            "same_support": _share("peers", lambda p: (F.signum(p["v"]) == F.signum(F.col("z"))) & moved(p)),
            "opposite": _share("peers", lambda p: (F.signum(p["v"]) == -F.signum(F.col("z"))) & moved(p)),
            "peer_up": _share("peers", lambda p: p["v"] >= 2.0),
            "peer_down": _share("peers", lambda p: p["v"] <= -2.0),
        }
    )
    df = settle(df.drop("_rc", "_rs", "peers", "pos"))
    return df.withColumns(_zscore_decision())


def _array_median(cells: str) -> Column:
    v = F.array_sort(F.transform(F.filter(cells, lambda p: p["v"].isNotNull()), lambda p: p["v"]))
    n = F.size(v)
    low = F.get(v, F.floor((n - 1) / 2).cast("int"))
    high = F.get(v, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _zscore_decision() -> dict[str, Column]:
    tz, rz = F.coalesce("tag_abs_z", F.lit(0.0)), F.coalesce(F.abs("residual_z"), F.lit(0.0))
    strong, high, warn = (tz >= 4.8) & (rz >= 4.5), (tz >= 3.5) & (rz >= 3.5), (tz >= 2.8) & (rz >= 2.8)
    supported = (tz >= 3.5) & (F.col("peer_high") >= 0.5) & (F.col("same_support") >= 0.5) & (F.col("opposite") < 0.35)
    alone = (tz >= 3.5) & (F.col("peer_high") <= 0.20) & (rz >= 3.5)
    against = (tz >= 3.5) & (F.col("opposite") >= 0.35) & (rz >= 3.5)
    mixed = (F.col("peer_up") >= 0.25) & (F.col("peer_down") >= 0.25)
    cls = (
        F.when(strong & (alone | against), "Actual Outlier - Strong Cluster Mismatch")
        .when(high & alone, "Actual Outlier - Isolated Tag")
        .when(high & against, "Actual Outlier - Opposite to Cluster")
        .when(supported, "Cluster Drift - Supported")
        .when(warn & mixed, "Warning - Mixed Cluster Behaviour")
        .when(warn, "Warning - Check Cluster Consistency")
        .otherwise("Normal")
    )
    status = F.split(cls, " - ")[0]
    raw = F.least(F.lit(35.0), tz * 6) + F.least(F.lit(45.0), rz * 9) + 15 * F.col("opposite") + F.when(tz >= 2.8, 10 * F.greatest(F.lit(0.0), 1 - F.col("same_support"))).otherwise(0.0)
    severity = F.when(status == "Cluster Drift", raw * 0.55).when(status == "Normal", F.least(raw, F.lit(25.0))).otherwise(raw)
    return {"final_class": cls, "final_status": status, "severity": F.rint(F.least(F.lit(100.0), severity))}


def pc1_fit(clean_z: Series, members: DataFrame) -> DataFrame:
    """First principal direction per cluster: ``cluster_id, tag, loading, center, explained``.

    Covariances of all tag pairs come from one pass of combined sums; the solve sees only
    the tag × tag table of one cluster.
    """
    pairs = pair_moments(clean_z)
    cov = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")).alias("c")
    cross = both_ways(pairs.select("tag_a", "tag_b", cov))
    own = clean_z.df.groupBy("tag").agg(F.var_pop("value").alias("_v"), F.count("value").alias("_n"), F.avg("value").alias("center"))
    diag = own.select(F.col("tag").alias("tag_a"), F.col("tag").alias("tag_b"), (F.col("_v") * F.col("_n")).alias("c"))
    a = members.select("cluster_id", F.col("tag").alias("tag_a"))
    b = members.select("cluster_id", F.col("tag").alias("tag_b"))
    cells = settle(cross.unionByName(diag)).join(a, "tag_a").join(b, ["cluster_id", "tag_b"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["tag_a"]))
        at = {t: i for i, t in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        m[pdf["tag_a"].map(at), pdf["tag_b"].map(at)] = pdf["c"].fillna(0.0)
        values, vectors = np.linalg.eigh(m)
        v = vectors[:, -1]
        top = np.max(np.abs(v))
        v = v / top if top >= 1e-12 else np.ones(len(names)) / np.sqrt(len(names))
        v = -v if v.sum() < 0 else v
        total = values.clip(0).sum()
        share = values[-1] / total if total > 0 else np.nan
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "tag": names, "loading": v, "explained": share})

    fits = cells.groupBy("cluster_id").applyInPandas(solve, "cluster_id string, tag string, loading double, explained double")
    return fits.join(own.select("tag", F.coalesce("center", F.lit(0.0)).alias("center")), "tag")


def cluster_pca(series: Series, local_limit: float = 0.40) -> DataFrame:
    """Tag z against the first component of its cluster; local breaks, persistence and cluster drift."""
    clean = clean_part(series, stepped_windows(series))
    ref = reference_profile(series, clean.df, "min")
    members, _ = corr_clusters(clean, 0.58, 3, 6)
    members = settle(members)
    scale = F.when(F.col("effective_scale") > 0, F.col("effective_scale")).otherwise(EPS)
    robust = F.when(F.col("mad_scale") > 0, F.col("mad_scale")).otherwise(scale)
    table = settle(ref.select("tag", F.col("mean").alias("_m"), scale.alias("_s"), F.col("median").alias("_c"), robust.alias("_k")))

    def scored(df: DataFrame) -> DataFrame:
        df = attach(df, table, "tag", series.tags)
        x = F.col("value")
        df = df.withColumns({"_sz": (x - F.col("_m")) / F.col("_s"), "_rz": (x - F.col("_c")) / F.col("_k")})
        return df.withColumn("z", signed_abs_z("_sz", "_rz")).drop("_sz", "_rz", "_m", "_s", "_c", "_k")

    clean_z = series.like(settle(scored(clean.df).select("ts", "tag", "row_index", F.coalesce("z", F.lit(0.0)).alias("value"))))
    fits = settle(pc1_fit(clean_z, members))
    z = scored(series.df).withColumn("_in", F.lit(True))
    z = z.join(clean.df.select("ts").distinct().withColumn("_clean", F.lit(True)), "ts", "left")
    links = fits.join(members, ["cluster_id", "tag"])
    df = attach(z, links, "tag", series.tags * 8, "inner").withColumn("_z0", F.coalesce("z", F.lit(0.0)) - F.col("center"))
    score = df.groupBy("ts", "cluster_id").agg((F.sum(F.col("_z0") * F.col("loading")) / F.sum(F.col("loading") * F.col("loading"))).alias("cluster_score"))
    df = df.join(score, ["ts", "cluster_id"]).withColumn("expected_z", F.col("cluster_score") * F.col("loading"))
    df = df.withColumn("residual", F.col("z") - F.col("expected_z"))
    key = F.concat_ws("\x1f", "cluster_id", "tag")
    df = settle(df.select("ts", "row_index", "cluster_id", F.col("tag").alias("name"), key.alias("tag"), "is_primary", "value", "z", "loading", "explained", "cluster_score", "expected_z", "residual", yes(F.col("_clean")).alias("_clean")))
    both = Series(df, None, series.tag_rows)
    res = center_mad(both, {"r": "residual"}, df.where("_clean"))
    mad = 1.4826 * F.col("r_mad") * 1.35
    scale = F.least(F.when(F.col("r_std") > EPS, F.col("r_std")), F.when(mad > EPS, mad))
    df = both.attach(res.select("tag", F.col("r_center").alias("_rc"), F.coalesce(scale, F.lit(1.0)).alias("_rs")), df)
    df = df.withColumn("residual_z", (F.col("residual") - F.col("_rc")) / F.col("_rs")).drop("_rc", "_rs")
    sign, want = F.signum("z"), F.signum("expected_z")
    facing = want != 0
    df = settle(df.withColumns({"_high": one(F.abs("z") >= 1.7), "_opp": one((sign == -want) & facing), "_same": one((sign == want) & facing)}))
    share = lambda c: F.sum(one(c)) / F.count(F.lit(1))
    rows = df.groupBy("ts", "cluster_id").agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("_high").alias("_highs"),
        F.sum("_opp").alias("_opps"),
        share(F.col("z") >= 1.7).alias("high_pos"),
        share(F.col("z") <= -1.7).alias("high_neg"),
        share(F.abs("z") >= 1.7).alias("high_any"),
        F.percentile(F.abs("residual_z"), F.lit(0.8)).alias("_p80"),
        share(F.abs("residual_z") >= 2.5).alias("residual_high"),
    )
    df = df.join(rows, ["ts", "cluster_id"])
    mixed = (F.col("high_pos") >= 0.25) & (F.col("high_neg") >= 0.25)
    others = F.col("_k") - 1
    tz, rz = F.coalesce(F.abs("z"), F.lit(0.0)), F.coalesce(F.abs("residual_z"), F.lit(0.0))
    df = df.withColumns(
        {
            "mixed": mixed,
            "cluster_drift": (F.abs("cluster_score") >= 1.8) & (F.col("high_any") >= 0.55) & ~mixed & yes(F.col("_p80") < 2.5),
            "peer_high": F.when(others > 0, (F.col("_highs") - F.col("_high")) / others).otherwise(0.0),
            "peer_opposite": F.when(others > 0, (F.col("_opps") - F.col("_opp")) / others).otherwise(0.0),
            "same_direction": F.when(others > 0, F.col("_same").cast("double")).otherwise(0.0),
        }
    )
    off = (F.col("peer_high") <= 0.30) | (F.col("same_direction") < 0.45) | (F.col("peer_opposite") >= 0.35) | F.col("mixed")
    df = df.withColumn("prelim", (tz >= 2.5) & (rz >= 2.5) & (F.col("residual_high") <= local_limit) & off)
    lane = neighbour_persist(both.lane(df), "prelim", "persistent")
    df = lane.done()
    single = (tz >= 3.1) & (rz >= 3.1) & (F.col("residual_high") <= 0.60)
    weak = (F.col("same_direction") < 0.45) | (F.col("peer_high") <= 0.30) | F.col("mixed")
    kind = (
        F.when(F.col("peer_high") <= 0.30, "Actual Outlier - Isolated From Cluster")
        .when((F.col("same_direction") < 0.45) | (F.col("peer_opposite") >= 0.35), "Actual Outlier - Direction Mismatch")
        .when(F.col("mixed"), "Actual Outlier - Mixed Cluster Behaviour")
        .otherwise("Actual Outlier - Cluster Residual Break")
    )
    cls = (
        F.when(single & weak, "Actual Outlier - Strong Cluster Model Break")
        .when(F.col("prelim") & F.col("persistent"), kind)
        .when(F.col("cluster_drift") & (rz < 2.5), "Cluster Drift - Supported")
        .when((F.col("residual_high") > local_limit) & ((tz >= 2.0) | (rz >= 2.0)), "Cluster Pattern Drift - Not Isolated")
        .when(((tz >= 2.0) & (rz >= 2.0)) | F.col("mixed"), "Warning - Review Cluster Consistency")
        .otherwise("Normal")
    )
    status = F.when(cls.startswith("Actual"), "Actual Outlier").when(cls.startswith("Cluster"), "Cluster Drift").when(cls.startswith("Warning"), "Warning").otherwise("Normal")
    raw = F.least(F.lit(100.0), 8 * tz + 14 * rz + 12 * F.greatest(F.lit(0.0), 1 - F.col("same_direction")) + 10 * F.col("peer_opposite") + one(F.col("mixed")) * 10)
    severity = F.when(status == "Cluster Drift", raw * 0.6).when(status == "Normal", F.least(raw, F.lit(25.0))).otherwise(raw)
    df = df.withColumns({"final_class": cls, "final_status": status, "severity": F.round(severity, 1)})
    df = df.drop("tag").withColumnRenamed("name", "tag")
    out = keep_best_duplicate(df)
    return out.select("ts", "tag", "value", "cluster_id", "z", "expected_z", "residual_z", "peer_high", "peer_opposite", "mixed", "persistent", "final_class", "final_status", "severity")


def cluster_consistency(series: Series) -> DataFrame:
    """Ridge on five peers of the same group; breaks by residual, distance to the peers and their support."""
    rows = consistency_window(series)
    clean = clean_part(series, rows)
    tags = settle(series.df.select("tag").distinct())
    corr = settle(pearson(clean).select("tag_a", "tag_b", "r"))
    groups = settle(strong_groups(tags, corr))
    ways = both_ways(corr).withColumn("_a", F.round(F.abs("r"), 10))
    ways = ways.join(groups.select(F.col("tag").alias("tag_a"), F.col("group_id").alias("_ga")), "tag_a")
    ways = ways.join(groups.select(F.col("tag").alias("tag_b"), F.col("group_id").alias("_gb")), "tag_b")
    mates = F.sum(one(F.col("_ga") == F.col("_gb"))).over(Window.partitionBy("tag_a"))
    ways = ways.withColumn("_mates", mates).where((F.col("_mates") < 3) | (F.col("_ga") == F.col("_gb")))
    order = Window.partitionBy("tag_a").orderBy(F.desc("_a"), "tag_b")
    links = ways.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    links = settle(links.select(F.col("tag_a").alias("target"), F.col("tag_b").alias("peer"), "rank", "r", "_a"))
    mid_corr = links.groupBy(F.col("target").alias("tag")).agg(F.median("_a").alias("peer_corr"))
    base = settle(center_mad(series, {"c": "value"}, clean.df).select("tag", F.col("c_center").alias("_c"), scale_of("c", "std1", EPS).alias("_s")))
    pos = settle(Lane(series.df.select("ts").distinct(), [], ["ts"]).numbered("pos").done())
    df = series.attach(base, series.df.join(pos, "ts")).withColumn("z", (F.col("value") - F.col("_c")) / F.col("_s"))
    df = settle(df.select("ts", "row_index", "tag", "value", "pos", "z"))
    design = settle(regress.design_rows(series, links, 5))
    train = design.join(clean.df.select("ts").distinct(), "ts", "left_semi")
    models = settle(regress.fit(train, links, 5, 2.0, False, True))
    pred = regress.predict(design, models, 5, series.tags).select(F.col("target").alias("tag"), "ts", "predicted", "r2")
    df = df.join(pred, ["tag", "ts"], "left").withColumn("residual", F.col("value") - F.col("predicted"))
    in_clean = df.join(clean.df.select("ts", "tag"), ["ts", "tag"], "left_semi")
    res = center_mad(series, {"r": "residual"}, in_clean).select("tag", F.col("r_center").alias("_rc"), scale_of("r", "std1", EPS).alias("_rs"))
    near = peer_rows(df, links.withColumns({"sign": F.lit(1.0), "weight": F.lit(1.0), "lag": F.lit(0)}), series.tags, 5)
    df = series.attach(res.join(mid_corr, "tag", "left"), df).join(near, ["tag", "pos"], "left")
    z = F.abs("z")
    floor = F.least(F.greatest(F.lit(1.5), z * 0.40), F.lit(3.0))
    df = df.withColumns(
        {
            "residual_z": (F.col("residual") - F.col("_rc")) / F.col("_rs"),
            "cluster_diff_z": F.abs(F.col("z") - _array_median("peers")),
            "peer_abs_z": _array_median_abs("peers"),
            "peer_support": F.coalesce(_share("peers", lambda p: (F.signum(p["v"]) == F.signum(F.col("z"))) & (F.abs(p["v"]) >= floor)), F.lit(0.0)),
            "reliable": yes((F.col("r2") >= 0.5) | (F.col("peer_corr") >= 0.60)),
        }
    )
    # Written down so that the array work above is not repeated in every rule below.
    df = settle(df.drop("peers"))
    rz, cd, ps = F.coalesce(F.abs("residual_z"), F.lit(0.0)), F.coalesce("cluster_diff_z", F.lit(0.0)), F.col("peer_support")
    severe = (rz >= 8) & (cd >= 5.5) & (ps <= 0.20) & (z >= 3)
    moderate = (rz >= 7) & (cd >= 4.5) & (ps <= 0.25) & (z >= 3) & F.col("reliable")
    extreme = (z >= 8) & (cd >= 4.5) & (ps <= 0.25)
    df = df.withColumns({"_sure": yes(severe | extreme), "_raw": yes(severe | moderate | extreme)})
    df = run_length(series.lane(df), "_raw", "_run").done()
    actual = F.col("_sure") | (F.col("_raw") & (F.col("_run") >= 2))
    warning = (rz >= 5) & (cd >= 3.5) & (ps <= 0.25) & F.col("reliable")
    moved = ((z >= 3.5) | (rz >= 3.5)) & (ps >= 0.60) & (F.col("peer_abs_z") >= 1.2)
    cls = F.when(actual, "Actual Outlier").when(warning, "Warning - Check").when(moved, "Cluster Drift - Supported").otherwise("Normal")
    ten = F.lit(10.0)
    severity = 7.0 * F.least(rz, ten) + 7.0 * F.least(cd, ten) + 5.0 * F.least(z, ten) + 25.0 * (1 - ps)
    return df.select(
        "ts", "tag", "value", "predicted", "residual_z", "z", "cluster_diff_z", "peer_support", "reliable", cls.alias("final_class"), F.round(F.least(F.lit(100.0), severity), 1).alias("severity")
    )


def _array_median_abs(cells: str) -> Column:
    v = F.array_sort(F.transform(F.filter(cells, lambda p: p["v"].isNotNull()), lambda p: F.abs(p["v"])))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def relationship(series: Series, top_k: int = 7, max_lag: int = 3) -> DataFrame:
    """Lagged, signed peers of a learned relationship table; mismatch, regression residual and cluster metrics decide."""
    clean = clean_part(series, relation_window(series))
    ref = reference_profile(series, clean.df, "clamp")
    table = settle(ref.select("tag", F.col("mean").alias("_m"), F.col("effective_scale").alias("_s"), F.col("median").alias("_c"), F.col("mad_scale").alias("_k")))
    pos = settle(Lane(series.df.select("ts").distinct(), [], ["ts"]).numbered("pos").done())
    df = attach(series.df.join(pos, "ts"), table, "tag", series.tags)
    df = df.withColumns({"_sz": (F.col("value") - F.col("_m")) / F.col("_s"), "_rz": (F.col("value") - F.col("_c")) / F.col("_k")})
    df = settle(df.select("ts", "row_index", "tag", "value", "pos", blend_z("_sz", "_rz").alias("z")))
    clean_z = series.like(settle(df.join(clean.df.select("ts", "tag"), ["ts", "tag"], "left_semi").select("ts", "tag", "row_index", F.col("z").alias("value"))))
    rel = settle(tag_relationships(clean_z, max_lag, top_k))
    groups = settle(relation_communities(series.df.select("tag").distinct(), rel))
    order = Window.partitionBy("target").orderBy(F.desc("score"), "source")
    links = rel.where("selected").withColumn("rank", F.row_number().over(order))
    links = settle(links.select("target", F.col("source").alias("peer"), F.col("sign").cast("double"), F.greatest("score", F.lit(0.05)).alias("weight"), F.col("best_lag").alias("lag"), "rank"))
    near = peer_rows(df, links, series.tags, top_k)
    df = df.join(near, ["tag", "pos"], "left")
    vs, ws = F.transform("peers", lambda p: p["v"]), F.transform("peers", lambda p: p["w"])
    df = df.withColumn("peer_expected", weighted_median(vs, ws))
    # Model inputs: the signed peers by rank; a sign only flips the coefficient.
    cells = {f"x{k}": F.get(F.transform(F.filter("peers", lambda p, k=k: p["rank"] == k), lambda p: p["v"]), F.lit(0)) for k in range(1, top_k + 1)}
    design = settle(df.select(F.col("tag").alias("target"), "ts", "pos", F.col("z").alias("y"), *[c.alias(n) for n, c in cells.items()]))
    marked = design.join(clean.df.select("ts").distinct().withColumn("_clean", F.lit(True)), "ts", "left").withColumnRenamed("target", "tag")
    mids = settle(series.quantiles({f"_m{k}": (f"x{k}", 0.5) for k in range(1, top_k + 1)}, marked.where("_clean")))
    filled = attach(marked, mids, "tag", series.tags).withColumnRenamed("tag", "target")
    filled = filled.withColumns({f"x{k}": F.coalesce(f"x{k}", f"_m{k}") for k in range(1, top_k + 1)})
    models = settle(regress.fit(filled.where("_clean"), links, top_k, 0.8, False, True, 40))
    pred = regress.predict(filled, models, top_k, series.tags).select(F.col("target").alias("tag"), "pos", "predicted", "r2")
    df = df.join(pred, ["tag", "pos"], "left")
    df = df.withColumns({"_mis": F.col("z") - F.col("peer_expected"), "_res": F.col("z") - F.col("predicted")})
    df = settle(df)
    in_clean = df.join(clean.df.select("ts", "tag"), ["ts", "tag"], "left_semi")
    stats = center_mad(series, {"m": "_mis", "r": "_res"}, in_clean)
    stats = stats.select("tag", F.col("m_center").alias("_mc"), scale_of("m", "std1", EPS).alias("_ms"), F.col("r_center").alias("_rc"), scale_of("r", "std1", EPS).alias("_rs"))
    df = series.attach(stats, df)
    active = F.greatest(F.lit(0.65), 0.30 * F.abs("z"))
    alive = F.filter("peers", lambda p: F.abs(p["v"]) >= active)
    same = F.filter(alive, lambda p: F.signum(p["v"]) == F.signum(F.col("z")))
    df = df.withColumns(
        {
            "mismatch_z": (F.col("_mis") - F.col("_mc")) / F.col("_ms"),
            "residual_z": (F.col("_res") - F.col("_rc")) / F.col("_rs"),
            "support": F.when(F.size(alive) > 0, F.size(same) / F.size(alive)).otherwise(0.0),
            "active": F.when(F.size(alive) > 0, F.size(alive) / F.size("peers")).otherwise(0.0),
        }
    )
    df = settle(df.select("ts", "tag", "value", "z", "peer_expected", "predicted", "mismatch_z", "residual_z", "support", "active"))
    in_clean = df.join(clean.df.select("ts", "tag"), ["ts", "tag"], "left_semi")
    absolute = in_clean.select("tag", F.abs("z").alias("a"), F.abs("mismatch_z").alias("b"), F.abs("residual_z").alias("c"))
    q = series.quantiles({"_a": ("a", 0.992), "_b": ("b", 0.992), "_c": ("c", 0.992)}, absolute)
    bounds = (("_a", "value_limit", 2.45, 3.60), ("_b", "mismatch_limit", 2.05, 3.40), ("_c", "residual_limit", 2.15, 3.70))
    q = q.select("tag", *[F.coalesce(clip(c, low, high), F.lit(low)).alias(n) for c, n, low, high in bounds])
    df = series.attach(q.join(groups, "tag", "left"), df)
    high = F.abs("z") >= F.col("value_limit")
    mism, resid = yes(F.abs("mismatch_z") >= F.col("mismatch_limit")), yes(F.abs("residual_z") >= F.col("residual_limit"))
    metrics = run_cluster_metrics(df)
    df = df.join(metrics.select("ts", "cluster_id", "shift_share", "mismatch_share"), ["ts", "cluster_id"], "left")
    helped = (F.col("support") >= 0.52) & (F.col("active") >= 0.35)
    shift, pattern, alone = F.col("shift_share") >= 0.45, F.col("mismatch_share") >= 0.46, F.col("mismatch_share") <= 0.34
    cls = (
        F.when(high & mism & resid & ~helped & alone, "Actual Outlier - Strong")
        .when(((high & (mism | resid)) | (mism & resid & (F.abs("z") >= 1.65))) & ~helped & alone, "Actual Outlier")
        .when(pattern & (shift | mism | resid), "Cluster Pattern Drift")
        .when(shift & helped & ~mism & ~resid, "Cluster Drift - Supported")
        .when(high | mism | resid, "Warning - Check")
        .otherwise("Normal")
    )
    ratio = lambda c, limit: clip(F.abs(c) / F.col(limit), 0, 2)
    severity = 30 * ratio("z", "value_limit") + 35 * ratio("mismatch_z", "mismatch_limit") + 30 * ratio("residual_z", "residual_limit") + 12 * (1 - F.col("support"))
    return df.withColumns({"final_class": cls, "severity": F.round(F.least(F.lit(100.0), severity), 1)})


def run_cluster_metrics(df: DataFrame) -> DataFrame:
    """Per timestamp and cluster: tags, median and largest |z|, shares of shifted, high and mismatched tags, mean support."""
    off = yes(F.abs("mismatch_z") >= F.col("mismatch_limit")) | yes(F.abs("residual_z") >= F.col("residual_limit"))
    n = F.count(F.lit(1))
    return df.groupBy("ts", "cluster_id").agg(
        F.count_distinct("tag").alias("tags"),
        F.median(F.abs("z")).alias("median_abs_z"),
        F.max(F.abs("z")).alias("max_abs_z"),
        (F.sum(one(F.abs("z") >= 2.0)) / n).alias("shift_share"),
        (F.sum(one(F.abs("z") >= F.col("value_limit"))) / n).alias("high_share"),
        (F.sum(one(off)) / n).alias("mismatch_share"),
        F.avg("support").alias("mean_support"),
    )

