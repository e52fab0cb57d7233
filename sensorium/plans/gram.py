"""Sums of products, combined inside each task before anything is shuffled.

``pair_moments`` gives the moments of every pair of tags (optionally at a lag).
Readings are packed to one row per timestamp, each task multiplies its block of rows
as a matrix and sends out one small row per pair; pairs of readings are never listed.
``gram`` gives X'X per key for rows that already hold their columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.plans.attach import attach
from sensorium.plans.lane import Lane
from sensorium.series import Series
from sensorium.session import settle, task_rows

TAG_BLOCK = 1024
#: Tags on each side of a block of pair histograms; a block of 14 x 14 bins takes 25 MB.
HIST_BLOCK = 128


def tag_ids(series: Series) -> DataFrame:
    """Dense number, mean and range of each tag (one row per tag)."""
    table = series.df.groupBy("tag").agg(
        F.avg("value").alias("_mean"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    ids = Lane(table, [], ["tag"], series.tags).numbered("_id").done()
    return settle(ids.withColumn("_id", (F.col("_id") - 1).cast("int")))


def packed_rows(series: Series, ids: DataFrame, lags: int = 0) -> DataFrame:
    """One row per timestamp: arrays of tag numbers and centred values, plus those of earlier rows."""
    df = attach(series.df.where(F.col("value").isNotNull()), ids, "tag", series.tags, "inner")
    cell = F.struct(F.col("_id").alias("i"), (F.col("value") - F.col("_mean")).alias("x"))
    packed = df.groupBy("ts").agg(F.sort_array(F.collect_list(cell)).alias("p0"))
    if lags:
        # Rows are as wide as the tag list, so the size of a block is judged in readings.
        rows = packed.select("ts").count()
        limit = task_rows(df.sparkSession)
        bound = rows if rows * max(series.tags, 1) <= 16 * limit else max(rows, limit + 1)
        lane = Lane(packed, [], ["ts"], bound)
        packed = lane.rolling(lags, 0, lambda w: {f"p{k}": F.lag("p0", k).over(w) for k in range(1, lags + 1)}).done()
    out = []
    for k in range(lags + 1):
        out += [F.col(f"p{k}.i").alias(f"i{k}"), F.col(f"p{k}.x").alias(f"x{k}")]
    return packed.select("ts", *out)


def _dense(batch: pa.RecordBatch, k: int, width: int, shift: int) -> np.ndarray:
    """Matrix rows × tags of one packed column pair; missing cells are NaN, several readings of a cell are averaged."""
    ids, values = batch.column(f"i{k}"), batch.column(f"x{k}")
    lengths = np.nan_to_num(np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
    rows = np.repeat(np.arange(batch.num_rows), lengths)
    cols = ids.flatten().to_numpy(zero_copy_only=False) - shift
    place = rows * width + cols
    count = np.bincount(place, minlength=batch.num_rows * width)
    total = np.bincount(place, values.flatten().to_numpy(zero_copy_only=False), batch.num_rows * width)
    with np.errstate(invalid="ignore"):
        return (total / count).reshape(batch.num_rows, width)


_MOMENTS = "a int, b int, lag int, n double, sa double, sb double, saa double, sbb double, sab double"


def pair_moments(series: Series, lags: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """Moments of (tag a now, tag b ``lag`` rows earlier): ``a, b, lag, n, sa, sb, saa, sbb, sab``.

    At lag 0 each pair comes once with a < b by name order; at other lags both ways.
    Values are centred on the tag mean, which no second moment about a mean depends on.
    """
    ids = tag_ids(series) if ids is None else ids
    packed = packed_rows(series, ids, lags)
    tags = series.tags
    if tags <= TAG_BLOCK:
        parts = packed.mapInArrow(_moment_sums(lags, tags), _MOMENTS)
    else:
        parts = _blocked(packed, lags, tags)
    keys = ["a", "b", "lag"]
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    left = ids.select(F.col("_id").alias("a"), F.col("tag").alias("tag_a"))
    right = ids.select(F.col("_id").alias("b"), F.col("tag").alias("tag_b"))
    return attach(attach(sums, left, "a", tags), right, "b", tags).drop("a", "b")


def _moment_sums(lags: int, tags: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = _dense(batch, 0, tags, 0)
            for k in range(lags + 1):
                then = now if k == 0 else _dense(batch, k, tags, 0)
                _add(total, k, now, then)
        for k, sums in total.items():
            yield from _emit(k, sums, 0, 0)

    return run


def _add(total: dict, key, now: np.ndarray, then: np.ndarray) -> None:
    m, o = ~np.isnan(now), ~np.isnan(then)
    x, y = np.where(m, now, 0.0), np.where(o, then, 0.0)
    m, o = m.astype(float), o.astype(float)
    sums = [m.T @ o, x.T @ o, m.T @ y, (x * x).T @ o, m.T @ (y * y), x.T @ y]
    if key in total:
        for have, new in zip(total[key], sums):
            have += new
    else:
        total[key] = sums


def _emit(lag: int, sums: list[np.ndarray], shift_a: int, shift_b: int) -> Iterator[pa.RecordBatch]:
    a, b = np.nonzero(sums[0] > 0)
    keep = (a + shift_a < b + shift_b) if lag == 0 else (a + shift_a != b + shift_b)
    a, b = a[keep], b[keep]
    for at in range(0, len(a), 50_000):
        i, j = a[at : at + 50_000], b[at : at + 50_000]
        cols = [(i + shift_a).astype(np.int32), (j + shift_b).astype(np.int32), np.full(len(i), lag, np.int32)]
        cols += [s[i, j] for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in cols], ["a", "b", "lag", "n", "sa", "sb", "saa", "sbb", "sab"]
        )


def _blocked(packed: DataFrame, lags: int, tags: int) -> DataFrame:
    """Many tags: every task works on one pair of tag blocks, so its sums stay small."""
    blocks = -(-tags // TAG_BLOCK)
    spread = max(1, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (blocks * blocks))
    pairs = F.explode(F.expr(f"flatten(transform(sequence(0, {blocks - 1}), p -> transform(sequence(0, {blocks - 1}), q -> struct(p, q))))"))
    rows = packed.withColumn("_pq", pairs)
    rows = rows.withColumns({"bp": F.col("_pq.p"), "bq": F.col("_pq.q"), "_s": F.pmod(F.xxhash64("ts"), F.lit(spread))}).drop("_pq")

    def cut(i: str, x: str, block: str):
        zipped = F.arrays_zip(F.col(i).alias("i"), F.col(x).alias("x"))
        return F.filter(zipped, lambda c: F.floor(c["i"] / TAG_BLOCK) == F.col(block))

    out = {}
    for k in range(lags + 1):
        out[f"_a{k}"] = cut(f"i{k}", f"x{k}", "bq")
    out["_now"] = cut("i0", "x0", "bp")
    rows = rows.select("bp", "bq", "_s", *[c.alias(n) for n, c in out.items()])
    picks = [F.col("_now.i").alias("in"), F.col("_now.x").alias("xn")]
    for k in range(lags + 1):
        picks += [F.col(f"_a{k}.i").alias(f"i{k}"), F.col(f"_a{k}.x").alias(f"x{k}")]
    rows = rows.select("bp", "bq", "_s", *picks).repartition("bp", "bq", "_s").sortWithinPartitions("bp", "bq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        at = None
        for batch in batches:
            p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bp", "bq"))
            for key in sorted(set(zip(p.tolist(), q.tolist()))):
                if at is not None and key != at:
                    for (lag, _), sums in total.items():
                        yield from _emit(lag, sums, at[0] * TAG_BLOCK, at[1] * TAG_BLOCK)
                    total = {}
                at = key
                part = batch.filter(pa.array((p == key[0]) & (q == key[1])))
                named = part.rename_columns(["bp", "bq", "_s", "i99", "x99", *part.schema.names[5:]])
                now = _dense(named, 99, TAG_BLOCK, key[0] * TAG_BLOCK)
                for k in range(lags + 1):
                    _add(total, (k, 0), now, _dense(named, k, TAG_BLOCK, key[1] * TAG_BLOCK))
        if at is not None:
            for (lag, _), sums in total.items():
                yield from _emit(lag, sums, at[0] * TAG_BLOCK, at[1] * TAG_BLOCK)

    return rows.mapInArrow(run, _MOMENTS)


def _bin_codes(series: Series, ids: DataFrame, bins: int) -> DataFrame:
    """``ts, i, x``: number of the tag, and bin of its (averaged) reading in its range."""
    mean = series.df.where(F.col("value").isNotNull()).groupBy("ts", "tag").agg(F.avg("value").alias("value"))
    df = attach(mean, ids, "tag", series.tags, "inner")
    share = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    code = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("double")
    return df.select("ts", F.col("_id").alias("i"), code.alias("x"))


def pair_histograms(series: Series, ids: DataFrame, bins: int = 14) -> DataFrame:
    """Counts per pair of tags (a < b) and pair of equal-width bins over each tag's range."""
    df = _bin_codes(series, ids, bins)
    packed = df.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    packed = packed.select(F.col("p.i").alias("i0"), F.col("p.x").alias("x0"))
    tags = series.tags
    if tags > HIST_BLOCK:
        raise ValueError("so many tags are counted by pair_information, in blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bins * bins
        total = np.zeros((tags, tags * size))
        for batch in batches:
            codes = _dense(batch, 0, tags, 0)
            for a in range(tags - 1):
                own = codes[:, a]
                cell = own[:, None] * bins + codes[:, a + 1 :] + np.arange(a + 1, tags)[None, :] * size
                cell = cell[~np.isnan(cell)].astype(np.int64)
                total[a] += np.bincount(cell, minlength=tags * size)
        for a in range(tags):
            at = np.nonzero(total[a])[0]
            if len(at):
                cols = [np.full(len(at), a, np.int32), (at // size).astype(np.int32), (at % size // bins).astype(np.int32)]
                cols += [(at % bins).astype(np.int32), total[a][at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "ka", "kb", "n"])

    counts = packed.mapInArrow(run, "a int, b int, ka int, kb int, n double")
    counts = counts.groupBy("a", "b", "ka", "kb").agg(F.sum("n").alias("n"))
    left = ids.select(F.col("_id").alias("a"), F.col("tag").alias("tag_a"))
    right = ids.select(F.col("_id").alias("b"), F.col("tag").alias("tag_b"))
    return attach(attach(counts, left, "a", tags), right, "b", tags).drop("a", "b")


def pair_information(series: Series, ids: DataFrame, bins: int = 14) -> DataFrame:
    """``tag_a, tag_b, n, mi`` of every pair of any number of tags, from the same histograms.

    A task counts the pairs of two blocks of tags over a share of the timestamps; a second one adds up the shares of
    one tag's pairs and turns them into nats, so that only one short row per pair is written.
    """
    codes = _bin_codes(series, ids, bins)
    tags, wide = series.tags, HIST_BLOCK
    blocks = -(-tags // wide)
    pairs = blocks * (blocks + 1) // 2
    spread = max(1, int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // pairs)
    # a block of a timestamp's cells goes to every pair of blocks it is in
    cells = codes.select("ts", F.floor(F.col("i") / wide).cast("int").alias("own"), F.struct("i", "x").alias("cell"))
    packed = cells.groupBy("ts", "own").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("ts", F.least("own", "other").alias("bp"), F.greatest("own", "other").alias("bq"), "own", "cells")
    met = sent.groupBy("bp", "bq", "ts").agg(
        F.flatten(F.collect_list(F.when(F.col("own") == F.col("bp"), F.col("cells")))).alias("p"), F.flatten(F.collect_list(F.when(F.col("own") == F.col("bq"), F.col("cells")))).alias("q")
    )
    met = met.withColumn("s", F.pmod(F.xxhash64("ts"), F.lit(spread)))
    named = [F.col(f"{side}.{c}").alias(f"{c}{k}") for k, side in enumerate("pq") for c in "ix"]
    size = bins * bins

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bp", "bq"))
            for key in sorted(set(zip(p.tolist(), q.tolist(), strict=True))):
                if key != at:
                    if at is not None:
                        yield from give(at, total)
                    at, total = key, np.zeros((wide, wide * size))
                part = batch.filter(pa.array((p == key[0]) & (q == key[1])))
                left, right = (_dense(part, k, wide, key[k] * wide) for k in range(2))
                for a in range(wide):
                    cell = left[:, a, None] * bins + right + np.arange(wide)[None, :] * size
                    total[a] += np.bincount(cell[~np.isnan(cell)].astype(np.int64), minlength=wide * size)
        if at is not None:
            yield from give(at, total)

    def give(key: tuple[int, int], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(total.any(1))
        for a in used.tolist():
            values = [[key[0] * wide + a], [key[1]], [total[a].astype("<f8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["a", "bq", "h"])

    def inform(pdf: pd.DataFrame) -> pd.DataFrame:
        a, block = int(pdf["a"].iloc[0]), int(pdf["bq"].iloc[0])
        h = sum(np.frombuffer(v, "<f8") for v in pdf["h"]).reshape(wide, bins, bins)
        n = h.sum((1, 2))
        rows, cols = h.sum(2, keepdims=True), h.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            term = h / n[:, None, None] * np.log(h * n[:, None, None] / (rows * cols))
        b = block * wide + np.arange(wide)
        keep = (n > 0) & (b > a)
        return pd.DataFrame({"a": np.int32(a), "b": b[keep].astype(np.int32), "n": n[keep], "mi": np.nansum(term, (1, 2))[keep]})

    parts = met.select("bp", "bq", "s", *named).repartition("bp", "bq", "s").sortWithinPartitions("bp", "bq").mapInArrow(count, "a int, bq int, h binary")
    sums = parts.groupBy("a", "bq").applyInPandas(inform, "a int, b int, n double, mi double")
    left = ids.select(F.col("_id").alias("a"), F.col("tag").alias("tag_a"))
    right = ids.select(F.col("_id").alias("b"), F.col("tag").alias("tag_b"))
    return attach(attach(sums, left, "a", tags), right, "b", tags).drop("a", "b")


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """X'X per key over rows without missing values, X = (1, columns): ``keys, g array<double>``.

    Every task adds up its own rows first, so the shuffle carries one short row per
    key and task whatever the size of a key.
    """
    keys, columns = list(keys), list(columns)
    width = len(columns) + 1
    slim = df.select(*keys, *columns).dropna(subset=columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*keys).schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in frames:
            for key, part in pdf.groupby(keys, sort=False):
                x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
                have = total.get(key)
                total[key] = x.T @ x if have is None else have + x.T @ x
        for key, g in total.items():
            flat = g.ravel()
            out = pd.DataFrame({"k": np.arange(len(flat), dtype=np.int32), "v": flat})
            for name, value in zip(keys, key):
                out.insert(0, name, value)
            yield out[[*keys, "k", "v"]]

    cells = slim.mapInPandas(run, f"{schema}, k int, v double")
    sums = cells.groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    packed = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("_kv"))
    return packed.select(*keys, F.col("_kv.v").alias("g")).where(F.size("g") == width * width)


__all__ = ["HIST_BLOCK", "gram", "packed_rows", "pair_histograms", "pair_information", "pair_moments", "tag_ids"]
