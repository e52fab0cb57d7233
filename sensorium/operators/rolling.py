"""Rolling detector: each reading judged by the consensus vote over the frame that ends with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.operators.consensus import MULTI_SIGNAL, ConsensusConfig
from sensorium.operators.windows import rolling_baseline
from sensorium.series import Series

# The share, floors and least sizes of the baseline.
OFF_SHARE, ABS_FLOOR, REL_FLOOR = 0.05, 1e-9, 0.10
MAD = 1.4826
#: Frames of more readings would need the long and early signals, which a frame cannot hold for each of its rows.
LONGEST = 35


def _median(x: np.ndarray) -> np.ndarray:
    """Row medians; NaN is missing, a row without values is NaN."""
    n = (~np.isnan(x)).sum(1)
    ordered = np.sort(x, 1)
    rows = np.arange(len(x))
    low, high = ordered[rows, np.maximum(n - 1, 0) // 2], ordered[rows, np.minimum(n // 2, x.shape[1] - 1)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def _quantile(x: np.ndarray, p: float) -> np.ndarray:
    n = (~np.isnan(x)).sum(1)
    ordered = np.sort(x, 1)
    rows, at = np.arange(len(x)), np.maximum(n - 1, 0) * p
    low = np.floor(at).astype(int)
    a, b = ordered[rows, low], ordered[rows, np.minimum(low + 1, np.maximum(n - 1, 0))]
    return np.where(n > 0, a + (b - a) * (at - low), np.nan)


def _scale(x: np.ndarray, least: float) -> np.ndarray:
    """MAD scale of each row, at least ``least``; NaN without values."""
    mad = MAD * _median(np.abs(x - _median(x)[:, None]))
    return np.where(np.isnan(mad), np.nan, np.maximum(mad, least))


def _trimmed(x: np.ndarray, tail: float, least: np.ndarray) -> np.ndarray:
    """Values between the tail quantiles, where enough are left; else all."""
    if tail <= 0:
        return x
    n = (~np.isnan(x)).sum(1)
    with np.errstate(invalid="ignore"):
        inside = (x >= _quantile(x, tail)[:, None]) & (x <= _quantile(x, 1 - tail)[:, None])
    trim = (n >= 10) & (inside.sum(1) >= least)
    return np.where(trim[:, None] & ~inside, np.nan, x)


def judge(frames: np.ndarray, peer: np.ndarray, cfg: ConsensusConfig) -> tuple[np.ndarray, np.ndarray]:
    """Signals fired and class of the last reading of every frame (rows of ``frames``, oldest first; NaN is missing).

    ``peer`` holds the peer z of the frame's last rows, as many as the vote looks back. Rows before the frame's
    first one (``-inf``) are not part of it.
    """
    x = np.where(np.isneginf(frames), np.nan, frames)
    m, width = x.shape
    least = cfg.min_mad
    with np.errstate(invalid="ignore", divide="ignore"):
        n = (~np.isnan(x)).sum(1)
        floor = np.maximum(ABS_FLOOR, REL_FLOOR * np.maximum(_scale(x, least), ABS_FLOOR))
        low = np.abs(x) <= floor[:, None]
        off_mode = low.sum(1) >= OFF_SHARE * np.maximum(n, 1)
        on = ~low & ~np.isnan(x)
        active = np.where((off_mode & on.any(1))[:, None] & low, np.nan, x)
        level = _trimmed(active, cfg.trim, np.clip(np.floor(0.35 * n), 25, 100))
        center, scale = _median(level), _scale(level, least)
        q1, q3 = _quantile(level, 0.25), _quantile(level, 0.75)
        iqr = np.where(q3 - q1 <= 0, scale, q3 - q1)
        step = np.diff(x, axis=1)
        steps = (~np.isnan(step)).sum(1)
        diff_scale = _scale(_trimmed(step, cfg.trim, np.clip(np.floor(steps / 3), 25, 80)), least)
        diff_scale = np.where(np.isnan(diff_scale), least, diff_scale)

        # the isolation rule looks at the last rows: ``radius`` of them before the one judged
        back = cfg.radius + 1
        half = cfg.local_window // 2
        fired = np.zeros((m, back), int)
        fives = np.zeros((m, back), bool)
        offs = np.zeros((m, back), bool)
        middles = {}

        def local_median(at: int) -> np.ndarray:
            # windows are centred, so those of late rows are cut at the frame's end
            if at not in middles:
                part = x[:, max(0, at - half) : at + half + 1]
                middles[at] = np.where((~np.isnan(part)).sum(1) >= cfg.local_min, _median(part), np.nan)
            return middles[at]

        for k in range(back):
            at = width - back + k
            v = x[:, at]
            off = off_mode & (np.abs(v) <= floor)
            away = np.stack([np.abs(x[:, j] - local_median(j)) for j in range(max(0, at - half), min(width, at + half + 1))], 1)
            spread = np.where((~np.isnan(away)).sum(1) >= cfg.local_min, np.maximum(MAD * _median(away), least), np.nan)
            votes = [
                (scale > least) & (np.abs(v - center) / scale >= cfg.k_global),
                np.abs(v - local_median(at)) / spread >= cfg.k_local,
                (iqr > 0) & ((v < q1 - cfg.k_fence * iqr) | (v > q3 + cfg.k_fence * iqr)),
                (diff_scale > least) & (np.abs(step[:, at - 1]) / diff_scale >= cfg.k_diff),
                np.abs(peer[:, k]) >= cfg.k_peer,
            ]
            fired[:, k] = np.where(off, 0, np.sum(votes, 0))
            fives[:, k] = votes[4] & ~off
            offs[:, k] = off
    last = fired[:, -1]
    actual = (fives[:, -1] & (last >= cfg.n_actual)) | (last >= cfg.n_actual_strict)
    near = (fired >= cfg.n_warning).sum(1)
    lone = actual & (near <= 1) & (last < cfg.isolation_keep)
    code = np.where(offs[:, -1], 0, np.where(actual & ~lone, 2, np.where(actual | (last >= cfg.n_warning), 1, 0)))
    return last, code


CLASSES = ("Normal", "Warning", "Actual Outlier")


def rolling_consensus(series: Series, window: int = 30, cfg: ConsensusConfig = MULTI_SIGNAL, peer: DataFrame | None = None) -> DataFrame:
    """Every reading after a tag's first ``window`` rows, judged on the rows up to it.

    Result: baseline of the ``window`` rows before (mean, std, z, limits), ``signals_fired`` and ``final_class`` of the
    vote over those rows and the reading itself, and ``status``. Frames are as short as the vote's long and early
    signals leave out; the peer signal comes from ``peer`` (tag, ts, z_peer) where it is given. Each frame is gathered
    once per reading, from the few neighbour rows that a block borrows.
    """
    if not cfg.radius + 1 < window < LONGEST:
        raise ValueError(f"the window has to be above {cfg.radius + 1} and below {LONGEST}")
    back = cfg.radius + 1
    df = series.df
    if peer is not None:
        df = df.join(peer.select("tag", "ts", F.col("z_peer").alias("_z")), ["tag", "ts"], "left")
    else:
        df = df.withColumn("_z", F.lit(None).cast("double"))
    lane = series.lane(df).numbered("_at")
    # collect_list leaves nulls out, so a missing reading travels as NaN
    gathered = lane.rolling(
        window,
        0,
        lambda w: {
            "_frame": F.collect_list(F.coalesce("value", F.lit(float("nan")))).over(w.rowsBetween(-window, 0)),
            "_peer": F.collect_list(F.coalesce("_z", F.lit(float("nan")))).over(w.rowsBetween(-(back - 1), 0)),
        },
    ).done()
    gathered = gathered.where(F.col("_at") > window).select("tag", "ts", "row_index", "_frame", "_peer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frames = batch.column("_frame").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, window + 1)
            peers = batch.column("_peer").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, back)
            fired, code = judge(frames, peers, cfg)
            classes = pa.array(CLASSES).take(pa.array(code))
            yield pa.RecordBatch.from_arrays([batch.column("tag"), batch.column("ts"), batch.column("row_index"), pa.array(fired, pa.int64()), classes], ["tag", "ts", "row_index", "signals_fired", "final_class"])

    kind = {f.name: f.dataType.simpleString() for f in gathered.schema.fields}
    judged = gathered.mapInArrow(run, f"tag string, ts {kind['ts']}, row_index {kind['row_index']}, signals_fired long, final_class string")
    base = rolling_baseline(series, window, cfg.k_global)
    out = base.join(judged, ["tag", "ts", "row_index"])
    status = F.when(F.col("final_class") == "Normal", "Normal").otherwise("Outlier")
    return out.withColumns({"status": status, "reason": F.concat("final_class", F.format_string(" (signals=%d)", F.col("signals_fired")))})
