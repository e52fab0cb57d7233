"""Causal path graph and root-cause ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.functions.scalar import drift_lead_score, fixed
from sensorium.operators.drift import drift_metrics
from sensorium.operators.pairs import average_ranks, granger
from sensorium.series import Series
from sensorium.session import settle

ARROW = r"\s*(?:->|→)\s*"


def split_path(path: Column | str) -> Column:
    """Tags of a path text."""
    c = F.col(path) if isinstance(path, str) else path
    return F.filter(F.transform(F.split(c, ARROW), lambda t: F.trim(t)), lambda t: t != "")


def path_table(paths: DataFrame) -> DataFrame:
    """Distinct non-empty paths with their tags."""
    p = paths.select(F.trim("path").alias("path")).where((F.col("path").isNotNull()) & (F.col("path") != "")).distinct()
    return p.withColumn("tags", split_path("path"))


def graph_edges(paths: DataFrame) -> DataFrame:
    """Distinct consecutive pairs of all paths, without self edges."""
    p = path_table(paths)
    steps = F.transform(
        F.sequence(F.lit(1), F.size("tags") - 1),
        lambda i: F.struct(F.element_at("tags", i).alias("src"), F.element_at("tags", i + 1).alias("dst")),
    )
    edges = p.where(F.size("tags") > 1).select(F.explode(steps).alias("e")).select("e.src", "e.dst")
    return edges.where("src <> dst").distinct()


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """All ``(src, dst)`` with a path from src to dst; ``start`` limits the sources (column ``src``).

    One join per level of depth; each level is written down, so lost executors cost at most one level.
    """
    edges = settle(edges.select("src", "dst"))
    reach = edges if start is None else edges.join(start.select("src").distinct(), "src", "left_semi")
    reach = settle(reach)
    frontier = reach
    hop = edges.select(F.col("src").alias("_via"), F.col("dst").alias("_next"))
    while frontier.limit(1).count():
        grown = frontier.join(hop, F.col("dst") == F.col("_via")).select("src", F.col("_next").alias("dst")).distinct()
        frontier = settle(grown.join(reach, ["src", "dst"], "left_anti"))
        reach = settle(reach.unionByName(frontier))
    return reach.where("src <> dst")


def ancestors(edges: DataFrame, target: str) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = closure(back, edges.sparkSession.createDataFrame([(target,)], "src string"))
    return reach.select(F.col("dst").alias("tag"))


def descendants(edges: DataFrame, target: str) -> DataFrame:
    reach = closure(edges, edges.sparkSession.createDataFrame([(target,)], "src string"))
    return reach.select(F.col("dst").alias("tag"))


def target_relations(edges: DataFrame, target: str) -> DataFrame:
    """Every other node with its relation to the target: direct, indirect, descendant or independent."""
    nodes = edges.select(F.col("src").alias("tag")).union(edges.select("dst")).distinct().where(F.col("tag") != target)
    direct = edges.where(F.col("dst") == target).select(F.col("src").alias("tag"), F.lit(1).alias("_d")).distinct()
    up = ancestors(edges, target).withColumn("_u", F.lit(1))
    down = descendants(edges, target).withColumn("_n", F.lit(1))
    df = nodes.join(direct, "tag", "left").join(up, "tag", "left").join(down, "tag", "left")
    relation = (
        F.when(F.col("_d") == 1, "direct")
        .when(F.col("_u") == 1, "indirect")
        .when(F.col("_n") == 1, "descendant")
        .otherwise("independent")
    )
    return df.select("tag", relation.alias("relation"))


def paths_to_target(edges: DataFrame, target: str, depth: int = 6) -> DataFrame:
    """All simple paths of at most ``depth`` edges that end in the target: ``source, path array``."""
    edges = settle(edges.select("src", "dst"))
    level = settle(edges.where(F.col("dst") == target).select(F.array("src", "dst").alias("path")))
    found = level
    for _ in range(depth - 1):
        head = level.withColumn("_head", F.col("path")[0])
        grown = head.join(edges.withColumnRenamed("dst", "_head"), "_head")
        grown = grown.where(~F.array_contains("path", F.col("src")))
        level = settle(grown.select(F.concat(F.array("src"), F.col("path")).alias("path")))
        found = found.unionByName(level)
    return found.select(F.col("path")[0].alias("source"), "path")


def drift_children(paths: DataFrame, drifted: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Tags that directly follow the first mention of a drifted tag in some path."""
    p = path_table(paths).select("tags", F.explode(F.array_distinct("tags")).alias("tag"))
    p = p.join(drifted.select("tag"), "tag", "left_semi")
    at = F.array_position("tags", F.col("tag"))
    p = p.withColumn("child", F.when(at < F.size("tags"), F.get("tags", at.cast("int"))))
    out = p.where(F.col("child").isNotNull() & (F.col("child") != F.col("tag"))).select("tag", "child").distinct()
    if allowed is not None:
        out = out.join(allowed.select(F.col("tag").alias("child")), "child", "left_semi").select("tag", "child")
    return out


def path_bonus(paths: DataFrame, target: str) -> DataFrame:
    """Per cause before the target in a path: direct and indirect bonus and the matching paths."""
    p = path_table(paths).where(F.array_contains("tags", target))
    at = F.array_position("tags", F.lit(target)).cast("int")
    p = p.withColumn("prefix", F.slice("tags", 1, at - 1)).where(F.size("prefix") > 0)
    rows = p.select("path", F.element_at("prefix", -1).alias("_last"), F.explode(F.array_distinct("prefix")).alias("cause"))
    rows = rows.withColumn("_direct", F.col("cause") == F.col("_last"))
    return rows.groupBy("cause").agg(
        F.max(F.when(F.col("_direct"), 1).otherwise(0)).alias("direct_bonus"),
        F.max(F.when(~F.col("_direct"), 1).otherwise(0)).alias("indirect_bonus"),
        F.array_join(F.sort_array(F.collect_set("path")), " | ").alias("matched_paths"),
    )


def propagation_paths(paths: DataFrame, causes: DataFrame, target: str) -> DataFrame:
    """Sub-path from each cause to the target in the given paths, or a plain ``cause -> target``."""
    p = path_table(paths).where(F.array_contains("tags", target))
    p = p.select("tags", F.explode(F.array_distinct("tags")).alias("cause"))
    a = F.array_position("tags", F.col("cause")).cast("int")
    b = F.array_position("tags", F.lit(target)).cast("int")
    sub = p.where(a < b).select("cause", F.array_join(F.slice("tags", a, b - a + 1), " -> ").alias("propagation_path"))
    df = causes.select("cause").join(sub.distinct(), "cause", "left")
    source = F.when(F.col("propagation_path").isNull(), "Fallback").otherwise("Example_Paths")
    text = F.coalesce("propagation_path", F.concat("cause", F.lit(f" -> {target}")))
    return df.select("cause", text.alias("propagation_path"), source.alias("path_source"))


def min_max_norm(c: str, by: list[str] | None = None) -> Column:
    """(x - min) / (max - min + 1e-9) over the rows of a bounded ranking table; constant gives 0."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low + 1e-9)).otherwise(0.0)


def paired(series: Series, pairs: DataFrame) -> tuple[Series, DataFrame]:
    """Common rows of each (target, cause): a series of causes under a pair key, and target values beside."""
    y = series.df.select("ts", F.col("tag").alias("target"), F.col("value").alias("y"))
    x = series.df.select("ts", F.col("tag").alias("cause"), "value")
    rows = pairs.select("target", "cause").join(y, "target").join(x, ["ts", "cause"])
    rows = rows.where(F.col("y").isNotNull() & F.col("value").isNotNull())
    rows = settle(rows.withColumn("tag", F.concat_ws("\x1f", "target", "cause")))
    return Series(rows.select("ts", "tag", "value"), None, series.tag_rows), rows


def _named(df: DataFrame) -> DataFrame:
    parts = F.split("tag", "\x1f")
    return df.withColumns({"target": parts[0], "cause": parts[1]}).drop("tag")


def pair_evidence(series: Series, pairs: DataFrame, max_lag: int = 7, need: int = 30) -> DataFrame:
    """Drift of the cause, best leading lag, Granger strength, Spearman and drift lead per pair."""
    twin, rows = paired(series, settle(pairs))
    drift = _named(drift_metrics(twin))
    lane = twin.lane(rows.select("ts", "tag", "value", "y", F.lit(0).cast("long").alias("row_index")))
    lane = lane.rolling(max_lag, 0, lambda w: {f"_x{k}": F.lag("value", k).over(w) for k in range(1, max_lag + 1)})
    lags = lane.done().groupBy("tag").agg(
        F.count(F.lit(1)).alias("rows"), *[F.corr(f"_x{k}", "y").alias(f"_r{k}") for k in range(1, max_lag + 1)]
    )
    best = F.array_min(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"_r{k}").isNotNull() & ~F.isnan(f"_r{k}"),
                        F.struct((-F.round(F.abs(f"_r{k}"), 12)).alias("s"), F.lit(k).alias("lag"), F.col(f"_r{k}").alias("r")),
                    )
                    for k in range(1, max_lag + 1)
                ]
            )
        )
    )
    lags = lags.withColumn("_b", F.when(F.col("rows") >= max_lag + 10, best))
    lags = _named(lags.select("tag", "rows", F.col("_b.lag").alias("best_lag"), F.col("_b.r").alias("lag_r")))
    xs = average_ranks(twin).df.select("ts", "tag", F.col("value").alias("_rx"))
    ys = average_ranks(twin.like(rows.select("ts", "tag", F.col("y").alias("value")))).df.select("ts", "tag", F.col("value").alias("_ry"))
    rho = _named(xs.join(ys, ["ts", "tag"]).groupBy("tag").agg(F.corr("_rx", "_ry").alias("rho")))
    tests = granger(series, pairs.select("target", F.col("cause").alias("source")), max_lag).withColumnRenamed("source", "cause")
    own = drift_metrics(series).select(F.col("tag").alias("target"), F.col("first_drift_ts").alias("target_drift_ts"))
    keys = ["target", "cause"]
    df = lags.where(F.col("rows") >= need).join(drift, keys).join(rho, keys, "left").join(tests, keys, "left").join(own, "target", "left")
    lead = F.coalesce(drift_lead_score(F.col("first_drift_ts"), F.col("target_drift_ts")), F.lit(0.0))
    return df.withColumns(
        {
            "rho": F.coalesce(F.when(~F.isnan("rho"), F.col("rho")), F.lit(0.0)),
            "granger_strength": F.coalesce("granger_strength", F.lit(0.0)),
            "drift_lead": lead,
        }
    )


def root_causes_graph(series: Series, edges: DataFrame, targets: DataFrame, importance: DataFrame | None = None, top: int = 10, depth: int = 6) -> DataFrame:
    """Ranked causes of each target: its ancestors in the graph, or every other tag when it has none.

    ``importance`` (target, cause, importance) comes from a model; without it that part counts 0.
    """
    tags = series.df.select("tag").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = closure(back, targets.select(F.col("tag").alias("src"))).select(F.col("src").alias("target"), F.col("dst").alias("cause"))
    up = settle(up.join(tags.select(F.col("tag").alias("cause")), "cause", "left_semi"))
    lonely = targets.select(F.col("tag").alias("target")).join(up.select("target"), "target", "left_anti")
    others = lonely.join(tags.select(F.col("tag").alias("cause")), F.col("target") != F.col("cause"))
    pairs = settle(up.select("target", "cause").unionByName(others))
    df = pair_evidence(series, pairs)
    direct = edges.select(F.col("src").alias("cause"), F.col("dst").alias("target"), F.lit(1).alias("_d"))
    reach = up.select("target", "cause", F.lit(1).alias("_u"))
    df = df.join(direct, ["target", "cause"], "left").join(reach, ["target", "cause"], "left")
    if importance is not None:
        df = df.join(importance.select("target", "cause", "importance"), ["target", "cause"], "left")
    else:
        df = df.withColumn("importance", F.lit(0.0))
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "importance": F.coalesce("importance", zero),
            "_lag": F.abs("lag_r"),
            "_rho": F.abs("rho"),
            "relation": F.when(F.col("_d") == 1, "Direct").when(F.col("_u") == 1, "Indirect").otherwise("Other"),
        }
    )
    by = ["target"]
    df = settle(df)
    # Weights of model, Granger, lag, drift lead, path and correlation evidence.
    score = (
        0.30 * min_max_norm("importance", by)
        + 0.20 * F.col("granger_strength")
        + 0.15 * F.coalesce(min_max_norm("_lag", by), zero)
        + 0.15 * F.col("drift_lead")
        + 0.10 * F.when(F.col("_u") == 1, 1.0).otherwise(0.0)
        + 0.10 * F.coalesce(min_max_norm("_rho", by), zero)
    )
    df = df.withColumn("final_score", score)
    order = Window.partitionBy("target").orderBy(F.desc("final_score"), "cause")
    return df.withColumn("rank_order", F.row_number().over(order)).where(F.col("rank_order") <= top).drop("_d", "_u", "_lag", "_rho")


def root_causes_paths(series: Series, paths: DataFrame, target: str, importance: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Direct, indirect and combined score of every other tag as a cause of one target."""
    tags = series.df.select(F.col("tag").alias("cause")).distinct().where(F.col("cause") != target)
    df = pair_evidence(series, tags.withColumn("target", F.lit(target)))
    df = df.join(path_bonus(paths, target), "cause", "left")
    if importance is not None:
        df = df.join(importance.select("cause", "importance"), "cause", "left")
    else:
        df = df.withColumn("importance", F.lit(0.0))
    df = settle(df.withColumns({"importance": F.coalesce("importance", F.lit(0.0)), "_lag": F.abs("lag_r"), "_rho": F.abs("rho")}))
    zero = F.lit(0.0)
    model, lag, rho = (F.coalesce(min_max_norm(c, ["target"]), zero) for c in ("importance", "_lag", "_rho"))
    df = df.withColumns({"_model": model, "_lagn": lag, "_rhon": rho})
    d = F.coalesce(F.col("direct_bonus"), F.lit(0))
    i = F.coalesce(F.col("indirect_bonus"), F.lit(0))
    g, lead = F.col("granger_strength"), F.col("drift_lead")
    direct = 0.30 * F.col("_model") + 0.20 * g + 0.15 * F.col("_lagn") + 0.15 * lead + 0.10 * d + 0.10 * F.col("_rhon")
    indirect = 0.20 * F.col("_model") + 0.20 * g + 0.15 * F.col("_lagn") + 0.15 * lead + 0.25 * i + 0.05 * F.col("_rhon")
    df = df.withColumns({"direct_score": direct, "indirect_score": indirect})
    df = df.withColumns(
        {
            "root_score": F.greatest(F.col("direct_score"), 0.9 * F.col("indirect_score")),
            "cause_type": F.when(F.col("direct_score") >= F.col("indirect_score"), "Direct").otherwise("Indirect"),
        }
    )
    return df.drop("_lag", "_rho", "_model", "_lagn", "_rhon").orderBy(F.desc("root_score"), "cause").limit(top)


def cause_reasons(causes: DataFrame) -> DataFrame:
    """One evidence sentence per ranked cause."""
    parts = F.array_compact(
        F.array(
            F.when(F.col("drift_flag"), "the cause drifted"),
            F.when(F.col("best_lag").isNotNull(), F.concat(F.lit("leads by "), F.col("best_lag").cast("string"), F.lit(" rows (r="), fixed("lag_r", 2), F.lit(")"))),
            F.when(F.col("granger_strength") > 0, F.concat(F.lit("Granger strength "), fixed("granger_strength", 2))),
            F.when(F.abs("rho") >= 0.3, F.concat(F.lit("rank correlation "), fixed("rho", 2))),
            F.when(F.col("drift_lead") > 0, F.concat(F.lit("drifted before the target (lead "), fixed("drift_lead", 2), F.lit(")"))),
        )
    )
    text = F.when(F.size(parts) == 0, "weak statistical evidence").otherwise(F.array_join(parts, "; "))
    return causes.withColumn("reason", F.concat("cause", F.lit(": "), text))
