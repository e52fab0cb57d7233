"""Trees, linear paths, winners, dynamic peers and attribution against plain versions and by their invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorium import Series
from sensorium.operators import causal, consensus, models
from sensorium.plans import trees


@pytest.fixture(scope="module")
def plant(spark):
    """A tag driven by two others (one as a step), a delayed copy, noise, and a tag of ten readings; gaps in one peer."""
    rng = np.random.default_rng(11)
    n = 400
    a, b, noise = rng.normal(50, 5, n), rng.normal(10, 2, n), rng.normal(0, 1, (n, 3))
    step = np.where(b > 10, 8.0, -8.0)
    target = 2 * a + step + noise[:, 0]
    late = np.concatenate([[target[0]], target[:-1]]) + noise[:, 1]
    tags = {"a": a, "b": b, "target": target, "late": late, "noise": noise[:, 2]}
    stamps = pd.date_range("2024-01-01", periods=n, freq="h")
    rows = [(t.to_pydatetime(), k, tag, float(v)) for tag, values in tags.items() for k, (t, v) in enumerate(zip(stamps, values)) if not (tag == "b" and k % 17 == 3)]
    rows += [(stamps[k].to_pydatetime(), k, "short", float(k)) for k in range(10)]
    return Series(spark.createDataFrame(rows, "ts timestamp_ntz, row_index long, tag string, value double")).stored()


def brute_split(codes, y, w, penalty=0.0):
    best = (1e-9, None, None)
    for f in range(codes.shape[1]):
        for cut in range(codes[:, f].max()):
            left = codes[:, f] <= cut
            wl, wr = w[left].sum(), w[~left].sum()
            if wl > 0 and wr > 0:
                sl, sr, s = (w * y)[left].sum(), (w * y)[~left].sum(), (w * y).sum()
                gain = sl**2 / (wl + penalty) + sr**2 / (wr + penalty) - s**2 / (w.sum() + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_splits_where_a_search_does(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 6, (80, 4))
    y, w = rng.normal(size=80) + codes[:, 2], rng.integers(0, 3, 80).astype(float)
    tree, gains = trees.grow(codes, y, w, 2, penalty=float(seed))
    gain, f, cut = brute_split(codes, y, w, float(seed))
    assert (tree.column[0], tree.cut[0]) == (f, cut)
    right = codes[:, f] > cut
    below = [brute_split(codes[m], y[m], w[m], float(seed)) for m in (~right, right)]
    found = [(int(c), int(t)) if c >= 0 else (None, None) for c, t in zip(tree.column[1:3], tree.cut[1:3])]
    assert found == [(b[1], b[2]) for b in below]
    assert abs(gains.sum() - gain - below[0][0] - below[1][0]) < 1e-6
    leaf = tree.walk(codes)
    for value in np.unique(leaf):
        own = leaf == value
        assert abs(value - (w * y)[own].sum() / (w[own].sum() + seed)) < 1e-9


def test_attribution_adds_up_to_the_prediction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = x[:, 0] - 2 * (x[:, 3] > 0)
    codes = trees.bin_codes(x, trees.bin_edges(x))
    model = trees.boost(codes, y, 40, 3, 0.1, 0.9, 0.9, 1.0)
    parts = np.zeros(codes.shape)
    predicted = model.predict(codes, parts)
    root = model.base + model.rate * sum(t.value[0] for t in model.trees)
    np.testing.assert_allclose(parts.sum(1) + root, predicted, atol=1e-9)
    assert set(np.argsort(np.abs(parts).mean(0))[-2:]) == {0, 3}


def test_linear_paths_meet_their_conditions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, 0.0, -2.0, 0.0] + rng.normal(size=200) * 0.1
    xc, yc = x - x.mean(0), y - y.mean()
    for mix in (0.5, 1.0):
        alphas = np.array([0.01, 0.3])
        for alpha, w in zip(alphas, trees.descend(xc, yc, alphas, mix)):
            slope = xc.T @ (yc - xc @ w) / 200 - alpha * (1 - mix) * w
            assert np.all(np.abs(slope[w == 0]) <= alpha * mix + 1e-6)
            np.testing.assert_allclose(slope[w != 0], alpha * mix * np.sign(w[w != 0]), atol=1e-5)
        base, w = trees.net(x, y, mix)
        np.testing.assert_allclose([base, *w], [0, 1, 0, -2, 0], atol=0.1)
    alpha = 2.0
    base, w = trees.ridge(x, y, np.array([alpha]))
    np.testing.assert_allclose(w, np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc), rtol=1e-9)
    # the leave-one-out error is that of really leaving rows out
    errors = []
    for k in range(200):
        keep = np.arange(200) != k
        b, v = trees.ridge(x[keep], y[keep], np.array([alpha]))
        errors.append((y[k] - b - x[k] @ v) ** 2)
    many = np.array([1e-3, alpha, 1e4])
    assert np.allclose(trees.ridge(x, y, many)[1], trees.ridge(x, y, many[[0]])[1]) and np.mean(errors) < 0.02


def filled(series):
    wide = series.df.toPandas().pivot(index="ts", columns="tag", values="value")
    return wide.fillna(wide.median())


def test_filled_correlation_matches_filling(plant):
    want = filled(plant).corr()
    got = models.filled_pearson(plant).collect()
    assert len(got) == 15
    for r in got:
        assert abs(r.r - want.loc[r.tag_a, r.tag_b]) < 1e-9, r


def test_importance_is_that_of_a_forest_on_the_filled_rows(plant):
    wide = filled(plant)
    names = ["a", "b", "late", "noise"]
    listed = plant.df.sparkSession.createDataFrame([("target", p, k + 1) for k, p in enumerate(names)], "target string, peer string, rank int")
    got = {r.peer: r.importance for r in models.tree_importance(plant, listed, 40, 5).collect()}
    x, y = wide[names].to_numpy()[:320], wide["target"].to_numpy()[:320]
    _, want = trees.forest(trees.bin_codes(x, trees.bin_edges(x)), y, 5, [models.SEED + t for t in range(40)])
    np.testing.assert_allclose([got[n] for n in names], want, rtol=1e-9)
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["b"] > got["noise"]


def test_dynamic_peers(plant):
    got = models.dynamic_peers(plant, most=3, trees_grown=30, depth=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.target, r.rank)):
        by.setdefault(r.target, []).append(r.peer)
        assert r.target != r.peer
    assert by["target"][:2] == ["a", "b"] and all(len(p) <= 3 for p in by.values())
    assert set(by) == {"a", "b", "target", "late", "noise", "short"}
    assert {r.rank for r in got if r.target == "short"} == {1, 2, 3}


def test_every_tag_has_a_winner_and_residuals(plant, blocks):
    peers = models.dynamic_peers(plant, most=4, trees_grown=15, depth=4).cache()
    winners = models.train_winners(plant, peers)
    rows = {r.target: r for r in winners.collect()}
    assert set(rows) == {"a", "b", "target", "late", "noise"}
    for r in rows.values():
        assert r.cv_rmse == min(c.cv_rmse for c in r.candidates) and r.model_name in {c.model_name for c in r.candidates}
    assert rows["target"].cv_r2 > 0.9
    whole = sorted((r.tag, r.ts, round(r.predicted, 9), r.z_peer) for r in models.peer_signal(plant, peers, winners).collect())
    blocks(60)
    cut = sorted((r.tag, r.ts, round(r.predicted, 9), r.z_peer) for r in models.peer_signal(Series(plant.df), peers, winners).collect())
    assert len(whole) == 5 * 400 - 24 and [w[:3] for w in whole] == [c[:3] for c in cut]
    assert np.allclose([w[3] for w in whole], [c[3] for c in cut])


def test_family_follows_the_shape():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    assert models.family_of(x[:100], x[:100, 0])[0] == "linear"
    assert models.family_of(x[:, :1], 3 * x[:, 0] + rng.normal(size=500) * 0.1)[0] == "linear"
    assert models.family_of(x[:, :1], x[:, 0] + x[:, 0] ** 2)[0] == "nonlinear"
    assert models.family_of(x, rng.normal(size=500))[0] == "nonlinear"
    steep = np.exp(3 * x[:, :2])
    assert models.family_of(steep, x[:, 0] + x[:, 1])[0] == "nonlinear"


def test_attribution_names_the_drivers(plant):
    listed = plant.df.sparkSession.createDataFrame([("late", p, k + 1) for k, p in enumerate(["a", "noise", "target"])], "target string, peer string, rank int")
    got = {r.cause: r for r in models.model_attribution(plant, listed).collect()}
    assert set(got) == {"a", "noise", "target"} and got["target"].importance > 5 * got["noise"].importance
    assert got["target"].test_r2 > 0.8


def test_multimodel_votes_for_every_reading(plant):
    df, winners = consensus.multimodel(plant, how=consensus.ModelConfig(max_peers=3))
    rows = df.select("tag", "predicted", "z_peer", "final_class").collect()
    assert len(rows) == plant.df.count() and winners.count() == 5
    assert all(r.predicted is not None for r in rows)


def test_importance_enters_the_root_causes(plant):
    spark = plant.df.sparkSession
    edges = spark.createDataFrame([("a", "target"), ("b", "target")], "src string, dst string")
    targets = spark.createDataFrame([("target",), ("noise",)], "tag string")
    weights = spark.createDataFrame([("target", "a", 1.0), ("target", "b", 3.0)], "target string, cause string, importance double")
    plain = {(r.target, r.cause): r.final_score for r in causal.root_causes_graph(plant, edges, targets).collect()}
    both = {(r.target, r.cause): r for r in causal.root_causes_graph(plant, edges, targets, weights).collect()}
    assert abs(both["target", "b"].final_score - plain["target", "b"] - 0.3) < 1e-6
    assert both["target", "a"].final_score == pytest.approx(plain["target", "a"])
    assert {r.relation for k, r in both.items() if k[0] == "noise"} == {"Other"}


def test_no_rows(spark):
    empty = Series(spark.createDataFrame([], "ts timestamp_ntz, row_index long, tag string, value double"))
    assert models.dynamic_peers(empty).count() == 0
    peers = spark.createDataFrame([], "target string, peer string, rank int")
    assert models.train_winners(empty, peers).count() == 0
    assert models.model_attribution(empty, peers).select(F.count("*")).first()[0] == 0
