"""Exact quantiles of a group of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.plans.attach import beside
from sensorium.plans.lane import Lane, largest_group
from sensorium.session import task_rows


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    bound: int | None = None,
    weight: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles (nulls ignored).

    ``wanted`` maps an output name to ``(column, probability)``. Groups that fit one
    task use the built-in aggregate. Larger ones are first counted per value, then
    ranked with block-wise running counts, so no task ever holds a whole group.
    ``weight`` names a column of positive whole repeat counts; ``extra`` aggregates are
    taken along in the same pass.
    """
    if bound is None:
        bound = largest_group(df, keys)
    if bound <= task_rows(df.sparkSession):
        by_column: dict[str, list[tuple[str, float]]] = {}
        for name, (c, p) in wanted.items():
            by_column.setdefault(c, []).append((name, float(p)))
        packed = df.groupBy(*keys).agg(
            *[
                F.percentile(c, F.array(*[F.lit(p) for _, p in probes]), F.col(weight) if weight else 1).alias(f"_q{i}")
                for i, (c, probes) in enumerate(by_column.items())
            ],
            *extra,
        )
        picks = {
            name: F.col(f"_q{i}")[j]
            for i, probes in enumerate(by_column.values())
            for j, (name, _) in enumerate(probes)
        }
        return packed.withColumns(picks).drop(*[f"_q{i}" for i in range(len(by_column))])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *extra)
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        probes = {name: p for name, (c, p) in wanted.items() if c == column}
        part = _ranked(df, list(keys), column, probes, weight)
        out = out.join(part, list(keys), "left") if keys else beside(out, part)
    return out.drop("_rows")


def _ranked(df: DataFrame, keys: list[str], column: str, probes: dict[str, float], weight: str | None) -> DataFrame:
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    )
    lane = Lane(counted, keys, ["_v"]).running({"_cum": ("sum", "_n")})
    sized = lane.done()
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    sized = sized.join(totals, keys) if keys else beside(sized, totals)
    picks = []
    for name, p in probes.items():
        h = (F.col("_all") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias(f"_l_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias(f"_h_{name}"))
    table = sized.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
    outs = []
    for name, p in probes.items():
        h = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        outs.append((low + (high - low) * (h - F.floor(h))).alias(name))
    return table.select(*keys, *outs)
