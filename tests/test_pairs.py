"""Histograms of many tags in blocks: the same as pair by pair."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorium import Series
from sensorium.operators import pairs
from sensorium.plans import gram

FIELDS = "ts timestamp_ntz, row_index long, tag string, value double"


def readings(spark, tags, rows, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 3))
    values = base[:, rng.integers(0, 3, tags)] + rng.normal(size=(rows, tags)) * rng.uniform(0.2, 3, tags)
    stamps = [t.to_pydatetime() for t in pd.date_range("2024-01-01", periods=rows, freq="h")]
    out = [(stamps[k], k, f"t{j:04d}", float(values[k, j])) for j in range(tags) for k in range(rows) if (k * 7 + j) % 13]
    return Series(spark.createDataFrame(out, FIELDS))


def test_blocks_of_tags_give_the_same_information(spark, monkeypatch):
    series = readings(spark, 23, 90)
    whole = {(r.tag_a, r.tag_b): (r.mi, r.mi_norm) for r in pairs.hist_mutual_info(series).collect()}
    for module in (gram, pairs):
        monkeypatch.setattr(module, "HIST_BLOCK", 5)
    cut = {(r.tag_a, r.tag_b): (r.mi, r.mi_norm) for r in pairs.hist_mutual_info(series).collect()}
    assert len(whole) == 23 * 22 // 2 and set(whole) == set(cut)
    for key, (mi, norm) in whole.items():
        assert abs(cut[key][0] - mi) < 1e-9 and abs(cut[key][1] - norm) < 1e-9


def test_more_tags_than_one_block_of_moments(spark):
    series = readings(spark, 1_100, 45, 1)
    mi = pairs.hist_mutual_info(series)
    assert mi.count() == 1_100 * 1_099 // 2
    wide = series.df.where(F.col("tag").isin("t0003", "t1090")).toPandas().pivot(index="ts", columns="tag", values="value")
    edges = [np.linspace(wide[t].min(), wide[t].max(), 15) for t in wide]
    h = np.histogram2d(*[wide.dropna()[t] for t in wide], bins=edges)[0] / len(wide.dropna())
    known = np.where(h > 0, h * np.log(np.where(h > 0, h, 1) / np.outer(h.sum(1), h.sum(0)).clip(1e-300)), 0).sum()
    got = mi.where("tag_a = 't0003' AND tag_b = 't1090'").first()
    assert len(wide.dropna()) < 40 or abs(got.mi - known) < 1e-6
