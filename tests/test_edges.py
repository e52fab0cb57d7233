"""Small hand-made frames: constants, short tags, spikes, ramps, mixed timestamps, odd headers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorium.operators import causal, consensus, detect, drift, pairs, regress, report, rows, stats, windows
from sensorium.plans.gram import pair_moments
from sensorium.series import Series
from sensorium.sources import ingest


def series(spark, tags, start="2024-01-01", step=3600):
    t0 = dt.datetime.fromisoformat(start)
    data = [(t0 + dt.timedelta(seconds=step * i), i, tag, None if v is None else float(v)) for tag, vs in tags.items() for i, v in enumerate(vs)]
    return Series(spark.createDataFrame(data, "ts timestamp_ntz, row_index long, tag string, value double"))


def test_constant_tag_under_every_policy(spark):
    s = series(spark, {"flat": [5.0] * 50})
    want = {"floor": 1e-9, "std1": 1e-9, "std0": 1e-9, "unit": 1.0, "ladder": 1e-9, "zero": None, "nan_poison": 1.0}
    for policy in stats.POLICIES + ("unit",):
        assert stats.robust_scale(s, policy).first()["scale"] == want[policy], policy


def test_zero_mad_falls_back_to_std(spark):
    s = series(spark, {"t": [0.0] * 30 + [10.0] * 10})
    got = stats.robust_scale(s).first()
    assert got["center"] == 0.0 and got["scale"] == pytest.approx(np.std([0.0] * 30 + [10.0] * 10, ddof=1))


def test_constant_pair_has_no_correlation(spark):
    s = series(spark, {"flat": [1.0] * 20, "up": range(20)})
    assert pairs.pearson(s).first()["r"] == 0.0
    assert pairs.pearson(s, zero_fill=False).first()["r"] is None


def test_single_spike_is_isolated_and_relabelled(spark):
    values = list(np.random.default_rng(1).normal(50, 1, 101))
    values[50] = 90.0
    s = series(spark, {"t": values})
    out = consensus.consensus(s, consensus.without_peers(consensus.CONSERVATIVE))
    row = out.where("row_index = 50").first()
    assert row["signals_fired"] == 4 and row["final_class"] == "Actual Outlier"
    lone = s.df.withColumn("final_class", F.when(F.col("row_index") == 50, "Strong Anomaly").otherwise("Normal"))
    again = windows.spike_relabel(s, lone).where("row_index = 50").first()
    assert again["final_class"] == "Spike - Returned Normal"


def test_ramp_fires_late_signals(spark):
    s = series(spark, {"t": [float(i) + (i % 3) * 0.2 for i in range(120)]})
    df = windows.trailing_regime_z(s).orderBy("ts").collect()
    assert all(r["z_long"] is None for r in df[:23]) and df[119]["z_long"] is not None
    assert windows.early_segment_z(s).orderBy(F.desc("ts")).first()["z_early"] > 3


def test_off_rows_are_normal(spark):
    rng = np.random.default_rng(2)
    s = series(spark, {"t": [0.0 if i % 5 < 3 else 100 + rng.normal() for i in range(200)]})
    out = consensus.consensus(s, consensus.without_peers(consensus.MULTI_SIGNAL))
    assert out.where("value = 0 AND final_class <> 'Normal'").count() == 0
    assert out.where("off_state").count() == 120


def test_missing_readings_are_outside_limits(spark):
    values = list(np.random.default_rng(3).normal(10, 1, 200))
    values[100] = None
    out = detect.deviation_inside(series(spark, {"t": values, "u": list(np.random.default_rng(4).normal(5, 1, 200))}))
    row = out.where("tag = 't' AND row_index = 100").first()
    assert row["outside_limit"] and row["final_class"] == "Unknown"


@pytest.mark.parametrize("n", [4, 5, 9, 10, 29, 30])
def test_short_tags_do_not_fail(spark, n):
    s = series(spark, {"t": list(range(n))})
    assert detect.simple_status(s).first()["num_flags"] == 0
    m = drift.drift_metrics(s).first()
    assert (m["ks_stat"] is None) == (min(int(n * 0.7), n - int(n * 0.7)) < 5)


def test_periods_merge_below_two_whole_days(spark):
    t0 = dt.datetime(2024, 1, 1)
    gaps = [0, 24, 24 + 47 + 59 / 60, 24 + 47 + 59 / 60 + 48]
    data = [(t0 + dt.timedelta(hours=g), i, "t", 1.0, "Drift", 3.0) for i, g in enumerate(gaps)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, row_index long, tag string, value double, final_class string, abs_z double")
    got = report.periods(Series(df), df).orderBy("start_ts").collect()
    assert [r["points"] for r in got] == [3, 1]


def test_mixed_timestamps(spark):
    texts = ["2024-05-03 10:00:00", "5/3/2022", "45000", "45000.5", "1700000000", "1700000000000", "12", "nonsense", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(ingest.parse_timestamp("t").alias("ts"))
    got = [r["ts"] for r in df.collect()]
    assert got[0] == dt.datetime(2024, 5, 3, 10) and got[1] == dt.datetime(2022, 5, 3)
    assert got[2] == dt.datetime(2023, 3, 15) and got[3] == dt.datetime(2023, 3, 15, 12)
    assert got[4] == got[5] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got[6:] == [None, None, None]


def test_headers_and_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF(" Time ", "x", "x", "")
    assert ingest.normalize_headers(df).columns == ["Time", "x", "x_1", "Column_3"]
    assert ingest.resolve_column(["Final Class", "TAG"], ["final_class"]) == "Final Class"
    assert ingest.resolve_column(["Final Class", "TAG"], ["tag"]) == "TAG"
    assert ingest.resolve_column(["a"], ["b"]) is None


def test_row_rules_keep_missing(spark):
    df = spark.createDataFrame([(1, 5.0, "run"), (2, None, "stop"), (3, 50.0, None)], "id int, p double, s string")
    kept = rows.drop_rows_where(df, [{"status_tag": "p", "operator": ">", "value": 10}, {"status_tag": "s", "operator": "==", "value": "stop"}])
    assert [r["id"] for r in kept.collect()] == [1]


def test_cyclic_paths_end(spark):
    paths = spark.createDataFrame([("A -> B → A",), ("A -> A",), (" B->C ",)], "path string")
    edges = causal.graph_edges(paths)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("A", "B"), ("B", "A"), ("B", "C")}
    assert {(r["src"], r["dst"]) for r in causal.closure(edges).collect()} == {("A", "B"), ("B", "A"), ("B", "C"), ("A", "C")}
    assert sorted(r["path"] for r in causal.paths_to_target(edges, "C").collect()) == [["A", "B", "C"], ["B", "C"]]


def test_f_tail_values():
    assert pairs.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert pairs.f_tail(2.7109, 5, 20) == pytest.approx(0.05, abs=1e-4)
    assert pairs.betainc(2, 3, 0.5) == pytest.approx(0.6875)


def test_granger_finds_the_driver(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=300)
    s = series(spark, {"x": x, "y": y})
    both = spark.createDataFrame([("y", "x"), ("x", "y")], "target string, source string")
    got = {r["target"]: r for r in pairs.granger(s, both, 3).collect()}
    assert got["y"]["p"] < 1e-6 and got["x"]["p"] > 1e-3

    def rss(cols, t):
        w, *_ = np.linalg.lstsq(cols, t, rcond=None)
        return ((t - cols @ w) ** 2).sum()

    best = 1.0
    for k in (1, 2, 3):
        t = y[k:]
        own = np.column_stack([np.ones(len(t))] + [y[k - j : len(y) - j] for j in range(1, k + 1)])
        full = np.column_stack([own] + [x[k - j : len(x) - j] for j in range(1, k + 1)])
        a, b = rss(own, t), rss(full, t)
        best = min(best, pairs.f_tail((a - b) / k / (b / (len(t) - 2 * k - 1)), k, len(t) - 2 * k - 1))
    assert got["y"]["p"] == pytest.approx(best, rel=1e-6, abs=1e-30)


@pytest.mark.parametrize("penalize,standardize,alpha", [(True, False, 1.0), (False, True, 2.0), (False, False, 0.0)])
def test_ridge_matches_numpy(spark, penalize, standardize, alpha):
    rng = np.random.default_rng(6)
    x1, x2 = rng.normal(30, 4, 80), rng.normal(5, 1, 80)
    y = 2 * x1 - x2 + rng.normal(size=80)
    s = series(spark, {"y": y, "x1": x1, "x2": x2})
    peers = spark.createDataFrame([("y", "x1", 1, 0.9), ("y", "x2", 2, 0.1)], "target string, peer string, rank int, r double")
    design = regress.design_rows(s, peers, 3).where("target = 'y'")
    got = regress.fit(design, peers, 3, alpha, penalize, standardize).first()
    raw = np.column_stack([x1, x2])
    m, d = (raw.mean(0), raw.std(0, ddof=1)) if standardize else (np.zeros(2), np.ones(2))
    a = np.column_stack([np.ones(80), (raw - m) / d])
    eye = np.eye(3)
    if not penalize:
        eye[0, 0] = 0
    w = np.linalg.solve(a.T @ a + alpha * eye, a.T @ y)
    slope = w[1:] / d
    assert got["w"][1:3] == pytest.approx(slope, rel=1e-6)
    assert got["w"][0] == pytest.approx(w[0] - slope @ m, rel=1e-6)
    assert got["w"][3] == 0.0


def test_peer_signal_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(10, 2, 120)
    y = 3 * x + rng.normal(size=120)
    y[60] += 30
    s = series(spark, {"x": x, "y": y})
    out = consensus.consensus(s, consensus.CONSERVATIVE).where("tag = 'y'").orderBy("ts").toPandas()
    med = np.median(y)
    z = (y - med) / (1.4826 * np.median(np.abs(y - med)))
    calm = np.abs(z) < 4
    a = np.column_stack([np.ones(120), x])
    w = np.linalg.solve(a[calm].T @ a[calm] + np.eye(2), a[calm].T @ y[calm])
    res = y - a @ w
    scale = 1.4826 * np.median(np.abs(res[calm] - np.median(res[calm])))
    assert out["z_peer"].to_numpy() == pytest.approx(res / scale, rel=1e-6)


def test_pair_moments_in_blocks(spark, monkeypatch):
    from sensorium.plans import gram

    rng = np.random.default_rng(9)
    s = series(spark, {f"t{i}": rng.normal(size=40) for i in range(5)})
    def table(df):
        return {(r["tag_a"], r["tag_b"], r["lag"]): tuple(round(r[c], 9) for c in ("n", "sa", "sb", "saa", "sbb", "sab")) for r in df.collect()}
    want = table(pair_moments(s, 2))
    monkeypatch.setattr(gram, "TAG_BLOCK", 2)
    assert table(gram.pair_moments(s, 2)) == want


def test_quiet_critical_tags_match_if_there_are_readings(spark):
    summary = spark.createDataFrame([("loud", 3)], "tag string, n long")
    readings = spark.createDataFrame([("loud",), ("a",)], "tag string")
    got = lambda critical: {tuple(r) for r in rows.keep_critical_tags(summary, critical, ["n"], readings).collect()}
    assert got(["a", "b"]) == {("a", 0), ("b", 0)}
    assert got(["b"]) == {("loud", 3)}
    assert got(["loud", "a"]) == {("loud", 3), ("a", 0)}


def test_critical_tags_beside_their_sql(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    for name, user in (("quiet", 1), ("unknown", 8)):
        folder = tmp_path / name
        folder.mkdir()
        con = duckdb.connect()
        con.execute(f"CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' AS ts, if(k < 3, {user}, 9) AS user_id, 'view' AS event_type, if(k < 3, 1.0, 300.0) AS value FROM range(6) t(k)")
        con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
        got = queries()["b12_keep_critical_tags"](spark, str(folder)).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(oracle_sql()["b12_keep_critical_tags"]).fetchall())
        assert len(got) == (5 if name == "quiet" else 1)


def test_isolation_hands_no_whole_tag_to_python(spark, monkeypatch):
    import pandas as pd
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    def bounded(kind):
        plain = kind.applyInPandas

        def apply(self, fn, schema):
            def run(*groups):
                assert max(map(len, groups)) <= 50 * 255 + 1
                return fn(*groups)

            if kind is PandasCogroupedOps:
                return plain(self, lambda a, b: run(a, b), schema)
            return plain(self, lambda a: run(a), schema)

        monkeypatch.setattr(kind, "applyInPandas", apply)

    bounded(PandasCogroupedOps)
    bounded(PandasGroupedOpsMixin)
    value = np.round(np.random.default_rng(3).normal(0, 1, 20_000), 3)
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "row_index": np.arange(len(value)), "tag": "t", "value": value}))
    got = detect.tail_isolation(Series(df)).select("row_index", "isolation_depth", "isolated").toPandas().sort_values("row_index")
    cuts = detect._cuts(50, 42)
    share = (value - value.min()) / (value.max() - value.min())
    leaf = np.stack([np.searchsorted(c, share, "left") + t * 256 for t, c in enumerate(cuts)], 1)
    depth = np.round(detect._depths(np.bincount(leaf.ravel(), minlength=50 * 256), 50)[leaf].mean(1), 9)
    assert (got["isolation_depth"].to_numpy() == depth).all()
    assert (got["isolated"].to_numpy() == (depth < np.round(np.quantile(depth, 0.02), 9))).all()
