"""The rolling detector against the vote run again on every frame; the weighted mean against a row loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorium import Series
from sensorium.operators import consensus, rolling, windows


def rows_of(values, tag):
    stamps = pd.date_range("2024-01-01", periods=len(values), freq="h")
    return [(t.to_pydatetime(), k, tag, None if np.isnan(v) else float(v)) for k, (t, v) in enumerate(zip(stamps, values))]


FIELDS = "ts timestamp_ntz, row_index long, tag string, value double"


@pytest.fixture(scope="module")
def readings():
    rng = np.random.default_rng(2)
    noisy = rng.normal(20, 1, 46)
    noisy[[33, 38, 39, 44]] += [9, 12, 12, -15]
    off = np.where(rng.random(44) < 0.3, 0.0, rng.normal(100, 3, 44))
    off[41] = 160
    flat = np.full(40, 7.0)
    flat[36] = 8
    gaps = rng.normal(0, 2, 45)
    gaps[[5, 11, 12, 34]] = np.nan
    gaps[40] = 30
    return {"noisy": noisy, "off": off, "flat": flat, "gaps": gaps, "few": rng.normal(size=30)}


@pytest.mark.parametrize("limit", [None, 40])
def test_rolling_matches_the_vote_on_every_frame(spark, readings, blocks, limit):
    series = Series(spark.createDataFrame([r for tag, v in readings.items() for r in rows_of(v, tag)], FIELDS))
    # every frame is a tag of its own, so that one run of the vote judges them all
    frames = [(t, k, f"{tag}/{end}", v) for tag, values in readings.items() for end in range(30, len(values)) for t, k, _, v in rows_of(values, tag)[end - 30 : end + 1]]
    whole = consensus.consensus(Series(spark.createDataFrame(frames, FIELDS)), consensus.without_peers(consensus.MULTI_SIGNAL))
    want = {}
    for r in whole.select("tag", "row_index", "signals_fired", "final_class").collect():
        tag, end = r.tag.split("/")
        if r.row_index == int(end):
            want[tag, r.row_index] = (r.signals_fired, r.final_class)
    if limit:
        blocks(limit)
    got = {(r.tag, r.row_index): (r.signals_fired, r.final_class) for r in rolling.rolling_consensus(series).collect()}
    assert got == want and {c for _, c in got.values()} == {"Normal", "Warning", "Actual Outlier"}


def test_peer_signal_counts(spark, readings):
    series = Series(spark.createDataFrame(rows_of(readings["noisy"], "noisy"), FIELDS))
    peer = series.df.select("tag", "ts", F.when(F.col("row_index") >= 43, 9.0).alias("z_peer"))
    plain = {r.row_index: r.signals_fired for r in rolling.rolling_consensus(series).collect()}
    with_peer = {r.row_index: r.signals_fired for r in rolling.rolling_consensus(series, peer=peer).collect()}
    assert {k: v - plain[k] for k, v in with_peer.items()} == {k: int(k >= 43) for k in plain}


def test_bounds_of_the_window(spark):
    empty = Series(spark.createDataFrame([], FIELDS))
    assert rolling.rolling_consensus(empty).count() == 0
    for window in (3, 35):
        with pytest.raises(ValueError, match="window"):
            rolling.rolling_consensus(empty, window)


@pytest.mark.parametrize("span", [1.5, 12, 400])
@pytest.mark.parametrize("limit", [None, 50])
def test_weighted_mean_matches_a_row_loop(spark, blocks, span, limit):
    rng = np.random.default_rng(4)
    values = {"long": rng.normal(1e3, 50, 700), "gaps": np.where(rng.random(300) < 0.4, np.nan, rng.normal(size=300)), "none": np.full(5, np.nan), "late": np.concatenate([np.full(20, np.nan), np.arange(10.0)])}
    series = Series(spark.createDataFrame([r for tag, v in values.items() for r in rows_of(v, tag)], FIELDS))
    if limit:
        blocks(limit)
    got = {(r.tag, r.row_index): r.ewma_prev for r in windows.ewma_prev(series, span).collect()}
    for tag, v in values.items():
        want = pd.Series(v).ewm(span=span, adjust=False, min_periods=1).mean().shift(1)
        for k, w in enumerate(want):
            assert (got[tag, k] is None) == np.isnan(w), (tag, k)
            assert np.isnan(w) or abs(got[tag, k] - w) <= 1e-9 * max(1, abs(w)), (tag, k)
