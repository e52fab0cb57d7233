"""Block paths give what plain windows give."""

from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorium.operators import stats, windows
from sensorium.operators.clean import best_window
from sensorium.plans.lane import Lane
from sensorium.plans.quantiles import quantiles
from sensorium.series import Series


def rows(df):
    def cell(v):
        return round(v, 9) if isinstance(v, float) else v

    cols = sorted(df.columns)
    return sorted([tuple(cell(r[c]) for c in cols) for r in df.collect()], key=str)


OPERATORS = {
    "diff": lambda s: windows.diff(s),
    "local": lambda s: windows.centered_median_mad(s, 5, 2),
    "trailing": lambda s: windows.trailing_regime_z(s, 6, 3),
    "smooth": lambda s: windows.time_rolling_mean(s, 1),
    "expanding": lambda s: windows.rolling_baseline(s, 5, expanding=True),
    "rolling": lambda s: windows.rolling_baseline(s, 5),
    "split": lambda s: windows.time_split(s),
    "runs": lambda s: windows.run_length(s.lane(s.df.withColumn("f", F.coalesce(F.col("value") > 50, F.lit(False)))), "f", "n").done(),
    "persist": lambda s: windows.persist_in_window(s.lane(s.df.withColumn("f", F.col("value") > 55)), "f", "p").done(),
    "scale": lambda s: stats.robust_scale(s),
    "ladder": lambda s: stats.robust_scale(s, "ladder", 1e-12),
    "profile": lambda s: stats.reference_profile(s, s.df, "clamp"),
    "trim": lambda s: stats.inner_trim(s, 0.15, 25),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks_match_plain(spark, frame, blocks, name):
    run = OPERATORS[name]
    want = rows(run(Series(frame)))
    blocks(20)
    assert rows(run(Series(frame))) == want


@pytest.mark.parametrize("limit", [1_000_000, 13])
def test_quantiles_interpolate(spark, frame, blocks, limit):
    blocks(limit)
    wanted = {f"q{p}": ("value", p / 100) for p in (0, 1, 25, 50, 99, 100)}
    got = {r["tag"]: r for r in quantiles(frame, ["tag"], wanted).collect()}
    pdf = frame.toPandas()
    for tag, part in pdf.groupby("tag"):
        for p in (0, 1, 25, 50, 99, 100):
            assert got[tag][f"q{p}"] == pytest.approx(part["value"].quantile(p / 100))


@pytest.mark.parametrize("limit", [1_000_000, 9])
def test_weighted_quantiles(spark, blocks, limit):
    blocks(limit)
    data = [(v, w) for v, w in zip([1.0, 2.0, 5.0, 9.0, 11.0, 12.0, 13.0, 20.0, 21.0, 30.0], [900, 3, 1, 40, 1, 1, 7, 1, 2, 5])]
    df = spark.createDataFrame(data, "value double, w long")
    flat = sorted(v for v, w in data for _ in range(w))
    row = quantiles(df, [], {"a": ("value", 0.5), "b": ("value", 0.97)}, weight="w").first()
    assert row["a"] == flat[len(flat) // 2] and row["b"] == pytest.approx(__import__("numpy").quantile(flat, 0.97))


def test_ties_in_one_timestamp_are_cut(spark, blocks):
    blocks(10)
    df = spark.range(60).select(F.lit("t").alias("k"), F.lit(0).alias("ts"), F.col("id"))
    pos = Lane(df, ["k"], ["ts", "id"]).numbered("p").done()
    assert [r["p"] for r in pos.orderBy("id").collect()] == list(range(1, 61))


@pytest.mark.parametrize("limit", [1_000_000, 11])
def test_running_fills_across_blocks(spark, blocks, limit):
    blocks(limit)
    df = spark.range(50).select(F.lit("t").alias("k"), F.col("id"), F.when(F.col("id") == 3, F.lit(7)).when(F.col("id") == 44, F.lit(9)).alias("v"))
    lane = Lane(df, ["k"], ["id"]).running({"back": ("last", "v"), "s": ("sum", "id")}).running({"ahead": ("last", "v")}, following=True)
    got = {r["id"]: r for r in lane.done().collect()}
    assert got[2]["back"] is None and got[30]["back"] == 7 and got[49]["back"] == 9
    assert got[0]["ahead"] == 7 and got[30]["ahead"] == 9 and got[45]["ahead"] is None
    assert all(got[i]["s"] == i * (i + 1) // 2 for i in range(50))


@pytest.mark.parametrize("limit", [1_000_000, 15])
def test_best_window_takes_the_earliest_minimum(spark, blocks, limit):
    blocks(limit)
    scores = [3, 1, 1, 1, 5, 1, 1, 1, 4, 9] * 5
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "ts long, score double")
    got = best_window(df, "score", lambda n: F.lit(3)).where("in_window").orderBy("ts").collect()
    assert [r["ts"] for r in got] == [1, 2, 3]


def test_frame_wider_than_a_block_is_refused(spark, frame, blocks):
    blocks(20)
    with pytest.raises(ValueError):
        Series(frame).lane().rolling(30, 0, lambda w: {"m": F.avg("value").over(w.rowsBetween(-30, 0))})


@pytest.mark.parametrize("limit", (17, 400))
def test_framed_medians_in_arrow_match_window_frames(spark, frame, blocks, monkeypatch, limit):
    """NaN is the largest value, missing values are left out, frames reach over blocks, short tags have shorter frames."""
    from sensorium.operators import consensus

    odd = F.when(F.col("row_index") % 31 == 5, float("nan")).when(F.col("row_index") % 29 == 4, float("-inf")).otherwise(F.col("value"))
    s = Series(frame.withColumn("value", odd))
    cfg = consensus.ConsensusConfig(local_window=7, local_min=3, long_window=8, long_min=3, short_window=3, short_min=2)
    monkeypatch.setattr(consensus, "FRAME_ROWS", limit)
    calls = []
    plain = Lane.rolling_arrow
    monkeypatch.setattr(Lane, "rolling_arrow", lambda self, *a: calls.append(self.whole) or plain(self, *a))
    got = rows(consensus.windowed_values(s, cfg))
    assert calls == [limit == 400]

    sizes = consensus.long_sizes(cfg, 9), {n: consensus.long_sizes(cfg, n) for n in (1, 4)}
    assert not any(any(v) for v in sizes[1].values())
    long, long_min, short, short_min = sizes[0]
    w = Window.partitionBy("tag").orderBy("ts", "row_index")
    far = lambda c: F.when(~F.col("tag").isin("short", "one"), c)
    med = windows.median_over
    df = s.df.withColumns({"_delta": F.col("value") - F.lag("value").over(w), "_lm": med("value", w.rowsBetween(-3, 3), 3)})
    df = df.withColumns({"_tm": far(med("value", w.rowsBetween(1 - long, 0), long_min)), "_sm": far(med("value", w.rowsBetween(1 - short, 0), short_min))})
    df = df.withColumns({"_ld": F.abs(F.col("value") - F.col("_lm")), "_td": F.abs(F.col("value") - F.col("_tm")), "_gap": F.col("_sm") - F.col("_tm")})
    df = df.withColumns({"_ls": med("_ld", w.rowsBetween(-3, 3), 3), "_ts": far(med("_td", w.rowsBetween(1 - long, 0), long_min))}).drop("_ld", "_td")
    # as text: NaN is not equal to itself
    assert list(map(str, got)) == list(map(str, rows(df)))


def test_tag_controls_over_framed_blocks(spark, frame, monkeypatch):
    from sensorium.operators import consensus

    controls = spark.createDataFrame([("hot", 3.0, ["S2_LOCAL", "S6_LONG"], "up"), ("a", None, None, "down")], consensus.CONTROL_FIELDS)
    cfg = consensus.without_peers(consensus.MULTI_SIGNAL)
    out = []
    for limit in (1000, 75):
        monkeypatch.setattr(consensus, "FRAME_ROWS", limit)
        df = consensus.consensus(Series(frame), replace(cfg, long_window=30, local_window=21), controls)
        out.append(rows(df.select("ts", "tag", "value", "z_local", "z_long", "z_gap", "signals_fired", "final_class")))
    assert out[0] == out[1] and len(out[0]) == frame.count()


def test_a_vote_over_blocks_orders_its_readings_once(spark, frame, monkeypatch):
    """Steps, early readings and neighbours take the blocks of the framed medians; no pass has one task per tag."""
    from sensorium.operators import consensus

    orders = []
    for name in ("__init__", "numbered"):
        plain = getattr(Lane, name)

        def noted(self, *a, plain=plain, **k):
            out = plain(self, *a, **k)
            if self.order == ["ts", "row_index"]:
                orders.append(self.whole)
            return out

        monkeypatch.setattr(Lane, name, noted)
    monkeypatch.setattr(consensus, "FRAME_ROWS", 75)
    cfg = replace(consensus.without_peers(consensus.MULTI_SIGNAL), long_window=30, local_window=21)
    df = consensus.consensus(Series(frame), cfg)
    assert orders == [False] and "_pos" not in df.columns and df.count() == frame.count()
