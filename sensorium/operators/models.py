"""Learned models of every tag in one job: candidate peers, importance, winning model, attribution.

Readings of a target and its peers become rows ``target, ts, y, x``; Spark spreads targets (and
shares of a forest) over the tasks. A model learns from at most ``TRAIN_ROWS`` evenly spaced
timestamps, a stated bound; correlations, fills and scores use every reading.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.operators.pairs import both_ways, f_tail, hist_mutual_info, moment_corr, pearson, spearman
from sensorium.operators.stats import center_mad, scale_of
from sensorium.operators.windows import lag_features
from sensorium.plans import trees
from sensorium.plans.attach import attach
from sensorium.plans.gram import pair_moments
from sensorium.plans.lane import Lane
from sensorium.series import Series
from sensorium.session import settle, task_rows

SEED = 42
TRAIN_ROWS = 8_000
#: Trees of a forest that one task grows.
SHARE = 15


def filled_pearson(series: Series) -> DataFrame:
    """r of every pair over all timestamps, a missing reading standing for its tag's median.

    Filling every gap would list timestamps x tags; the sums of a filled pair follow from the
    sums over common readings, those of each tag, and the number of timestamps.
    """
    mean = series.df.groupBy("tag").agg(F.avg("value").alias("_mean"))
    middle = series.quantiles({"_mid": ("value", 0.5)}).join(mean, "tag")
    centred = F.col("value") - F.col("_mean")
    sums = series.attach(middle).groupBy("tag").agg(
        F.count("value").alias("n"), F.sum(centred).alias("s"), F.sum(centred * centred).alias("ss"), F.first(F.col("_mid") - F.col("_mean")).alias("m")
    )
    times = series.df.select("ts").distinct().count()
    side = lambda k: sums.select(F.col("tag").alias(f"tag_{k}"), *[F.col(c).alias(f"_{c}{k}") for c in ("n", "s", "ss", "m")])
    pairs = pair_moments(series).where("lag = 0")
    pairs = attach(attach(pairs, settle(side("a")), "tag_a", series.tags), settle(side("b")), "tag_b", series.tags)
    total = lambda k: F.col(f"_s{k}") + (times - F.col(f"_n{k}")) * F.col(f"_m{k}")
    square = lambda k: F.col(f"_ss{k}") + (times - F.col(f"_n{k}")) * F.col(f"_m{k}") * F.col(f"_m{k}")
    # readings of one tag alone meet the other's median; where both are missing, the medians meet
    cross = (
        F.col("sab")
        + (F.col("_sa") - F.col("sa")) * F.col("_mb")
        + (F.col("_sb") - F.col("sb")) * F.col("_ma")
        + (times - F.col("_na") - F.col("_nb") + F.col("n")) * F.col("_ma") * F.col("_mb")
    )
    filled = pairs.select("tag_a", "tag_b", F.lit(float(times)).alias("n"), total("a").alias("sa"), total("b").alias("sb"), square("a").alias("saa"), square("b").alias("sbb"), cross.alias("sab"))
    return filled.select("tag_a", "tag_b", F.col("n").cast("long").alias("n"), moment_corr().alias("r"))


def pair_scores(series: Series, max_lag: int = 5) -> DataFrame:
    """``target, peer, r, mi, lag_r`` of every directed pair: filled correlation, mutual information, best lagged correlation."""
    r = both_ways(filled_pearson(series).select("tag_a", "tag_b", "r"))
    mi = both_ways(hist_mutual_info(series).select("tag_a", "tag_b", "mi"))
    m = pair_moments(series, max_lag).where("lag > 0 AND n >= 10").select("tag_a", "tag_b", "lag", moment_corr().alias("_r"))
    lag = m.groupBy("tag_a", "tag_b").agg(F.min(F.struct((-F.round(F.abs("_r"), 12)).alias("s"), "lag", "_r")).alias("_b"))
    df = r.join(mi, ["tag_a", "tag_b"], "left").join(lag.select("tag_a", "tag_b", F.col("_b._r").alias("lag_r")), ["tag_a", "tag_b"], "left")
    return settle(df.withColumnsRenamed({"tag_a": "target", "tag_b": "peer"}).fillna(0.0, ["r", "mi", "lag_r"]))


def candidates_of(scores: DataFrame, top: int = 10) -> DataFrame:
    """Peers among a target's ``top`` by any of the three scores; ``rank`` numbers them by name."""
    place = lambda c: F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round(F.abs(c), 10)), "peer"))
    df = scores.withColumns({f"_{c}": place(c) for c in ("r", "mi", "lag_r")})
    df = df.where((F.col("_r") <= top) | (F.col("_mi") <= top) | (F.col("_lag_r") <= top)).drop("_r", "_mi", "_lag_r")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("peer")))


def candidate_peers(series: Series, top: int = 10, max_lag: int = 5) -> DataFrame:
    """Distinct union of each target's best tags by correlation, mutual information and lag correlation."""
    return candidates_of(pair_scores(series, max_lag), top).select("target", "peer")


def even_times(series: Series, most: int) -> Series:
    """The readings of at most ``most`` evenly spaced timestamps."""
    times = series.df.select("ts").distinct()
    count = times.count()
    if count <= most:
        return series
    step = -(-count // most)
    kept = Lane(times, [], ["ts"], count).numbered("_at").done().where((F.col("_at") - 1) % step == 0).select("ts")
    df = series.df.join(kept, "ts", "left_semi")
    return Series(df, series.tags, min(series.tag_rows, most))


def peer_rows(series: Series, peers: DataFrame, values: Sequence[str] = ("value",), fill: DataFrame | None = None) -> DataFrame:
    """``target, ts, y, x array<double>``: a target's readings beside those of its peers, in rank order.

    ``fill`` (tag, value) stands for missing readings of a peer; without it they are null. Of several readings
    of a peer at one time the smallest is taken. Every reading is sent to the targets that use it.
    """
    named = settle(peers.select("target", "peer", F.col("rank").cast("int").alias("rank")))
    if fill is not None:
        with_fill = named.join(fill.select(F.col("tag").alias("peer"), F.col("value").alias("fill")), "peer", "left")
    else:
        with_fill = named.withColumn("fill", F.lit(None).cast("double"))
    width = settle(with_fill.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rank", "fill"))).alias("_peers")))
    cell = F.array(*[F.col(v).cast("double") for v in values])
    sent = attach(series.df.select("ts", F.col("tag").alias("peer"), cell.alias("v")), named, "peer", None, "inner").select("target", "ts", F.struct("rank", "v").alias("cell"), F.lit(None).cast("double").alias("y"), F.lit(0).alias("own"))
    kind = sent.schema["cell"].dataType.simpleString()
    own = series.df.select(F.col("tag").alias("target"), "ts", F.lit(None).cast(kind).alias("cell"), F.col("value").alias("y"), F.lit(1).alias("own"))
    own = own.join(F.broadcast(width.select("target")) if series.tags <= 100_000 else width.select("target"), "target", "left_semi")
    met = own.unionByName(sent).groupBy("target", "ts").agg(F.max("y").alias("y"), F.sort_array(F.collect_list("cell")).alias("_cells"), F.max("own").alias("own"))
    met = attach(met.where("own = 1").drop("own"), width, "target", series.tags)

    def place(p: Column) -> Column:
        held = F.get(F.filter("_cells", lambda c: c["rank"] == p["rank"]), 0)["v"]
        return F.coalesce(F.when(F.size(held) == len(values), F.transform(held, lambda v: F.coalesce(v, p["fill"]))), F.array(*[p["fill"]] * len(values)))

    return met.select("target", "ts", "y", F.flatten(F.transform("_peers", place)).alias("x"))


def medians(series: Series) -> DataFrame:
    """``tag, value``: what stands for a tag's missing readings."""
    return settle(series.quantiles({"value": ("value", 0.5)}).select("tag", F.coalesce("value", F.lit(0.0)).alias("value")))


def training_rows(series: Series, peers: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Rows with a reading of the target at even timestamps, peers' gaps filled with medians."""
    return settle(peer_rows(even_times(series, most), peers, fill=medians(series)).where(F.col("y").isNotNull()))


def matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("ts")
    return np.stack(pdf["x"].to_list()).astype(float), pdf["y"].to_numpy(float)


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|r| of each column with y; 0 without spread."""
    a, b = x - x.mean(0), y - y.mean()
    size = np.sqrt((a * a).sum(0) * (b * b).sum())
    return np.abs(a.T @ b) / np.where(size > 1e-12, size, np.inf)


def ranks(x: np.ndarray) -> np.ndarray:
    return pd.DataFrame(x).rank().to_numpy()


def tree_importance(series: Series, peers: DataFrame, trees_grown: int = 120, depth: int = 8, most: int = TRAIN_ROWS) -> DataFrame:
    """``target, peer, importance`` of every listed peer: mean share of gain in a forest on the first 80 % of a target's rows.

    ``peers`` holds target, peer and rank. With fewer than 40 rows the importance is |r|.
    """
    parts = -(-trees_grown // SHARE)
    rows = training_rows(series, peers, most).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = matrix(pdf)
        part, n = int(pdf["part"].iloc[0]), len(y)
        seeds = [SEED + t for t in range(part * SHARE, min((part + 1) * SHARE, trees_grown))]
        if n < 40:
            share = correlation(x, y) * len(seeds)
        else:
            test = int(np.ceil(n * (0.2 if n >= 50 else max(0.1, 5.0 / n))))
            x, y = x[: n - test], y[: n - test]
            _, share = trees.forest(trees.bin_codes(x, trees.bin_edges(x)), y, depth, seeds)
            share = share * len(seeds)
        return pd.DataFrame({"target": pdf["target"].iloc[0], "rank": np.arange(1, len(share) + 1), "share": share / trees_grown})

    shares = rows.groupBy("target", "part").applyInPandas(run, "target string, rank int, share double")
    found = shares.groupBy("target", "rank").agg(F.sum("share").alias("importance"))
    order = peers.select("target", "peer", F.row_number().over(Window.partitionBy("target").orderBy("rank")).alias("rank"))
    return order.join(found, ["target", "rank"]).select("target", "peer", "importance")


def dynamic_peers(series: Series, most: int = 5, min_abs: float = 0.35, top: int = 10, max_lag: int = 5, trees_grown: int = 120, depth: int = 8) -> DataFrame:
    """Peers of every target: ``target, peer, rank, r, mi, lag_r, importance``.

    Candidates are a target's ``top`` by correlation, mutual information or lagged correlation; the ``most``
    of highest importance stay if they correlate by ``min_abs`` or matter to the forest at all. Targets left
    without any (or with under 30 readings) get their best correlated tags.
    """
    scores = pair_scores(series, max_lag)
    sizes = series.df.groupBy("tag").agg(F.count("value").alias("n")).where("n >= 30").select(F.col("tag").alias("target"))
    listed = settle(candidates_of(scores, top).join(sizes, "target", "left_semi"))
    ranked = listed.drop("rank").join(tree_importance(series, listed, trees_grown, depth), ["target", "peer"])
    best = Window.partitionBy("target").orderBy(F.desc(F.round("importance", 12)), "peer")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    kept = ranked.where((F.abs("r") >= min_abs) | (F.col("importance") > 0))
    kept = settle(kept)
    plain = scores.where(F.col("r").isNotNull()).withColumn("_a", F.round(F.abs("r"), 10))
    by_r = Window.partitionBy("target").orderBy(F.desc("_a"), "peer")
    plain = plain.withColumns({"rank": F.row_number().over(by_r), "_best": F.max("_a").over(Window.partitionBy("target"))})
    plain = plain.where((F.col("rank") <= most) & ((F.col("_a") >= min_abs) | (F.col("_best") < min_abs)))
    plain = plain.join(kept.select("target"), "target", "left_anti").withColumn("importance", F.abs("r"))
    out = kept.unionByName(plain.select(*kept.columns))
    again = Window.partitionBy("target").orderBy("rank")
    return out.withColumn("rank", F.row_number().over(again)).select("target", "peer", "rank", "r", "mi", "lag_r", "importance")


# Learners of each family, and when a profile counts as linear.
LINEAR, NONLINEAR = ("ElasticNetCV", "RidgeCV", "LassoCV"), ("GradientBoosting", "RandomForest")
STRAIGHT, EXCESS, CHECKED, ENOUGH = 0.5, 0.05, 5, 2


def family_of(x: np.ndarray, y: np.ndarray, least: int = 150) -> tuple[str, str]:
    """Linear or nonlinear, and why: from |r| and |rho| of the columns, then a test of the straight fit's shape."""
    n = len(y)
    if n < least:
        return "linear", f"{n} rows are too few for nonlinear models"
    r, rho = correlation(x, y), correlation(ranks(x), ranks(y[:, None])[:, 0])
    order = np.argsort(r - rho, kind="stable")[:CHECKED]
    weak = (r < STRAIGHT) & (rho > r + EXCESS)
    if weak[order].sum() >= ENOUGH:
        return "nonlinear", f"{int(weak[order].sum())} of {len(order)} columns follow ranks more than a line"
    straight = (r >= STRAIGHT) & (rho <= r + EXCESS)
    mid_r, mid_rho = float(np.median(r)), float(np.median(rho))
    by_median = mid_r >= STRAIGHT and mid_rho <= mid_r + EXCESS
    by_count = straight[order].sum() >= max(ENOUGH, len(order) - 1)
    if not (by_median or by_count):
        return "nonlinear", f"median |r| {mid_r:.3f} and |rho| {mid_rho:.3f} do not support a line"
    mean, scale = trees.standard(x)
    z = np.column_stack([np.ones(n), (x - mean) / scale])
    fitted = z @ np.linalg.lstsq(z, y, rcond=None)[0]
    more = np.column_stack([z, fitted * fitted])
    rest = ((y - fitted) ** 2).sum()
    full = ((y - more @ np.linalg.lstsq(more, y, rcond=None)[0]) ** 2).sum()
    free = n - more.shape[1]
    if free > 0 and full > 0:
        p = f_tail((rest - full) / (full / free), 1, free)
        if p < 0.05:
            return "nonlinear", f"the square of the fit adds to it (p={p:.4f})"
    return "linear", f"median |r| {mid_r:.3f}, ranks say no more"


def fit_model(name: str, x: np.ndarray, y: np.ndarray) -> dict:
    """A fitted model as plain values."""
    if name in NONLINEAR:
        edges = trees.bin_edges(x)
        codes = trees.bin_codes(x, edges)
        if name == "RandomForest":
            grown = trees.forest(codes, y, 6, [SEED + t for t in range(60)])[0]
            return {"edges": edges, "forest": grown}
        return {"edges": edges, "boosted": trees.boost(codes, y, 60, 3, 0.1, 0.85, seed=SEED)}
    mean, scale = trees.standard(x)
    z = (x - mean) / scale
    base, w = trees.ridge(z, y) if name == "RidgeCV" else trees.net(z, y, 0.5 if name == "ElasticNetCV" else 1.0)
    return {"base": base - float((w / scale) @ mean), "weights": w / scale}


def apply_model(model: dict, x: np.ndarray) -> np.ndarray:
    if "weights" in model:
        return model["base"] + x @ model["weights"]
    codes = trees.bin_codes(x, model["edges"])
    if "forest" in model:
        return np.mean([t.walk(codes) for t in model["forest"]], axis=0)
    return model["boosted"].predict(codes)


_WINNER = "target string, model_name string, model_type string, cv_rmse double, cv_r2 double, train_rows long, reason string, candidates array<struct<model_name:string,cv_rmse:double,cv_r2:double>>, model binary"


def train_winners(series: Series, peers: DataFrame, folds: int = 3, least: int = 60, most: int = TRAIN_ROWS) -> DataFrame:
    """One row per target: the model of the lowest cross-validated RMSE in the family that its correlations suggest.

    ``candidates`` lists every model tried. Targets with fewer than ``least`` rows have no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = matrix(pdf)
        if len(y) < least:
            return pd.DataFrame(columns=["target", "model_name", "model_type", "cv_rmse", "cv_r2", "train_rows", "reason", "candidates", "model"])
        family, reason = family_of(x, y)
        fold = trees.folds_of(len(y), folds, SEED)
        tried = []
        for name in LINEAR if family == "linear" else NONLINEAR:
            errors, shares = [], []
            for f in range(folds):
                a, b = fold != f, fold == f
                miss = ((y[b] - apply_model(fit_model(name, x[a], y[a]), x[b])) ** 2).sum()
                spread = ((y[b] - y[b].mean()) ** 2).sum()
                errors.append(np.sqrt(miss / b.sum()))
                shares.append(1 - miss / spread if spread > 0 else 0.0)
            tried.append((name, float(np.mean(errors)), float(np.mean(shares))))
        name, rmse, r2 = min(tried, key=lambda t: (round(t[1], 12), t[0]))
        model = pickle.dumps(fit_model(name, x, y))
        listed = [{"model_name": n, "cv_rmse": e, "cv_r2": s} for n, e, s in tried]
        return pd.DataFrame([(pdf["target"].iloc[0], name, family, rmse, r2, len(y), reason, listed, model)], columns=["target", "model_name", "model_type", "cv_rmse", "cv_r2", "train_rows", "reason", "candidates", "model"])

    return settle(training_rows(series, peers, most).groupBy("target").applyInPandas(run, _WINNER))


def blocks(series: Series) -> int:
    """Groups that a target's rows are cut into, so that each fits a task."""
    return max(1, -(-series.tag_rows // task_rows(series.df.sparkSession)))


def predictions(series: Series, peers: DataFrame, models: DataFrame) -> DataFrame:
    """``target, ts, y, predicted`` of every reading whose target has a model; peers' gaps are filled with medians."""
    count = blocks(series)
    rows = peer_rows(series, peers, fill=medians(series)).withColumn("block", F.pmod(F.xxhash64("ts"), F.lit(count)))
    held = models.select("target", "model", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["target", "ts", "y", "predicted"])
        x = np.stack(left["x"].to_list()).astype(float)
        return left[["target", "ts", "y"]].assign(predicted=apply_model(pickle.loads(right["model"].iloc[0]), x))

    kind = rows.schema["ts"].dataType.simpleString()
    return rows.groupBy("target", "block").cogroup(held.groupBy("target", "block")).applyInPandas(run, f"target string, ts {kind}, y double, predicted double")


def peer_signal(series: Series, peers: DataFrame, models: DataFrame, min_mad: float = 1e-6) -> DataFrame:
    """``tag, ts, predicted, z_peer``: the models' residuals over their robust scale."""
    df = settle(predictions(series, peers, models).withColumnRenamed("target", "tag").withColumn("_res", F.col("y") - F.col("predicted")))
    scale = center_mad(series, {"r": "_res"}, df).select("tag", scale_of("r", "floor", min_mad).alias("_s"))
    z = F.when(F.col("_s") > min_mad, F.col("_res") / F.col("_s"))
    return series.attach(scale, df).select("tag", "ts", "predicted", z.alias("z_peer"))


# Size and rates of the attribution's boosted trees.
BOOST = {"rounds": 400, "depth": 4, "rate": 0.03, "rows": 0.9, "columns": 0.9, "penalty": 1.0}


def model_attribution(series: Series, peers: DataFrame, lags: int = 3, most: int = TRAIN_ROWS) -> DataFrame:
    """``target, cause, importance, test_rmse, test_r2``: what each peer's value and lags move a boosted model by.

    The model learns from the first 80 % of a target's complete rows; the importance is the mean over all of them of
    the absolute amount by which splits on a column move the prediction, added up over a peer's columns.
    """
    columns = ["value", *[f"lag{k}" for k in range(1, lags + 1)]]
    lagged = Series(lag_features(series, lags), series.tags, series.tag_rows)
    rows = settle(peer_rows(even_times(lagged, most), peers, columns).where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())))
    width = len(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = matrix(pdf)
        cut = int(len(y) * 0.8)
        if cut < 10:
            return pd.DataFrame(columns=["target", "rank", "importance", "test_rmse", "test_r2"])
        edges = trees.bin_edges(x[:cut])
        codes = trees.bin_codes(x, edges)
        model = trees.boost(codes[:cut], y[:cut], **BOOST, seed=SEED)
        parts = np.zeros(codes.shape)
        miss = (y - model.predict(codes, parts))[cut:]
        spread = ((y[cut:] - y[cut:].mean()) ** 2).sum()
        score = np.abs(parts).mean(0).reshape(-1, width).sum(1)
        r2 = 1 - (miss @ miss) / spread if spread > 0 else 0.0
        return pd.DataFrame({"target": pdf["target"].iloc[0], "rank": np.arange(1, len(score) + 1), "importance": score, "test_rmse": float(np.sqrt((miss @ miss) / len(miss))), "test_r2": float(r2)})

    found = rows.groupBy("target").applyInPandas(run, "target string, rank int, importance double, test_rmse double, test_r2 double")
    order = peers.select("target", F.col("peer").alias("cause"), F.row_number().over(Window.partitionBy("target").orderBy("rank")).alias("rank"))
    return order.join(found, ["target", "rank"]).drop("rank")


def keep_greedily(items: DataFrame, twins: DataFrame) -> DataFrame:
    """``target, tag`` rows that stay when a target's tags are taken by name and one like an earlier kept one is left out.

    ``twins`` (tag, other) lists like tags both ways. In each round tags without an undecided earlier twin are kept
    and their later twins leave; the first undecided tag of a target is always decided.
    """
    todo = settle(items.select("target", "tag"))
    later = settle(twins.where(F.col("tag") < F.col("other")).select(F.col("tag").alias("_first"), F.col("other").alias("tag")))
    kept = None
    while True:
        waiting = todo.join(later, "tag").join(todo.withColumnRenamed("tag", "_first"), ["target", "_first"], "left_semi").select("target", "tag")
        now = settle(todo.join(waiting, ["target", "tag"], "left_anti"))
        kept = now if kept is None else settle(kept.unionByName(now))
        gone = now.withColumnRenamed("tag", "_first").join(later, "_first").select("target", "tag")
        todo = settle(todo.join(now, ["target", "tag"], "left_anti").join(gone, ["target", "tag"], "left_anti"))
        if todo.isEmpty():
            return kept


def feature_filter(series: Series, targets: DataFrame | None = None, present: float = 0.65, similar: float = 0.92, top: int = 12) -> DataFrame:
    """``target, tag, rho, mi, r, f, score``: a target's ``top`` features, of all tags or those in ``targets`` (target).

    Features have readings at a share ``present`` of the timestamps, are not constant, and are not like an earlier kept
    one (|rho| of ``similar`` or more, taken by name); they are ranked by the sum of |rho|, mutual information and F.
    """
    total = series.df.select("ts").distinct().count()
    stats = series.df.groupBy("tag").agg(F.count("value").alias("n"), F.var_samp("value").alias("v"))
    usable = settle(stats.where((F.col("n") >= present * total) & (F.col("v") >= 1e-8)).select("tag"))
    rho = settle(both_ways(spearman(series).select("tag_a", "tag_b", F.abs("rho").alias("rho"))).withColumnsRenamed({"tag_a": "target", "tag_b": "tag"}))
    mine = rho.join(usable, "tag", "left_semi")
    if targets is not None:
        mine = mine.join(targets.select("target").distinct(), "target", "left_semi")
    kept = keep_greedily(mine, rho.where(F.col("rho") >= similar).select(F.col("target").alias("tag"), F.col("tag").alias("other")))
    mi = both_ways(hist_mutual_info(series).select("tag_a", "tag_b", "mi")).withColumnsRenamed({"tag_a": "target", "tag_b": "tag"})
    r = both_ways(pearson(series).select("tag_a", "tag_b", "n", "r")).withColumnsRenamed({"tag_a": "target", "tag_b": "tag"})
    df = mine.join(kept, ["target", "tag"]).join(mi, ["target", "tag"], "left").join(r, ["target", "tag"], "left")
    square = F.col("r") * F.col("r")
    f = F.when(F.abs("r") < 1, square / (1 - square) * (F.col("n") - 2)).otherwise(0.0)
    score = F.col("rho") + F.coalesce("mi", F.lit(0.0)) + F.coalesce(f, F.lit(0.0))
    best = Window.partitionBy("target").orderBy(F.desc(F.round("score", 9)), "tag")
    df = df.withColumns({"f": f}).withColumn("score", score).withColumn("rank", F.row_number().over(best))
    return df.where(F.col("rank") <= top).drop("n")
