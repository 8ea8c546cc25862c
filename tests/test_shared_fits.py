"""Kernel machines and forests that share work between settings and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.models import shared
from wavecohort.plans import blocks, cv, tuning


def rings(n, seed=0):
    """Two classes that no line separates."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1.0 + 2.0 * y + rng.normal(0, 0.25, n)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle), rng.normal(0, 1, n)]), y


def test_kernel_machine_is_at_its_minimum():
    x, y = rings(300)
    signs, weight = 2.0 * y - 1, np.where(y == 1, 3.0, 1.0)
    m = shared.KernelMachine(x, signs, weight, "auto", [0.1, 10.0], 64, 7)
    z = m._map(x)
    for i, c in enumerate([0.1, 10.0]):
        w = m.weights[:, i]
        assert np.abs(shared.slope(z, signs, c * weight, w)).max() < 1e-5
        rng = np.random.default_rng(i)
        near = [shared.loss(z, signs, c * weight, w + 1e-3 * rng.normal(size=len(w))) for _ in range(20)]
        assert min(near) > shared.loss(z, signs, c * weight, w)
    unseen, truth = rings(300, 1)
    assert ((m.decision(unseen)[:, 1] > 0) == truth).mean() > 0.93


def test_slope_is_the_derivative_of_the_loss():
    rng = np.random.default_rng(0)
    z, y, c, w = rng.normal(size=(40, 6)), rng.choice([-1.0, 1.0], 40), rng.uniform(0, 2, 40), rng.normal(size=6)
    for j in range(6):
        e = np.eye(6)[j] * 1e-6
        assert abs((shared.loss(z, y, c, w + e) - shared.loss(z, y, c, w - e)) / 2e-6 - shared.slope(z, y, c, w)[j]) < 1e-4


def test_forest_learns_and_its_parts_are_smaller_forests():
    x, y = rings(500)
    whole = shared.Forest(x, y, 2, np.ones(2), 60, 12, 1, 3)
    unseen, truth = rings(400, 1)
    points = [(60, 12), (60, 3), (20, 12), (20, 3)]
    got = whole.scores(unseen, points)
    assert (got[0].argmax(1) == truth).mean() > 0.9
    assert all(np.allclose(s.sum(1), 1) for s in got)
    # The first 20 trees are the same in a forest of 20, and a depth of 3 cuts them off.
    assert np.allclose(whole.scores(unseen, [(20, 12)])[0], got[2])
    deep, shallow = whole.scores(unseen, [(60, 12), (60, 0)])
    assert np.ptp(shallow, axis=0).max() < 1e-12 and np.ptp(deep, axis=0).max() > 0.5


@pytest.mark.parametrize("cost", [1.0, 4.0])
def test_one_tree_on_a_binary_feature_gives_class_shares(cost):
    """Shares of a stump on bootstrap rows; with the class weight they follow the weighted counts."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 1)).astype(float)
    y = (rng.random(4000) < np.where(x[:, 0] == 1, 0.8, 0.3)).astype(int)
    f = shared.Forest(x, y, 2, np.array([1.0, cost]), 200, 5, 5, 1)
    for v in (0.0, 1.0):
        p = y[x[:, 0] == v].mean()
        want = cost * p / (cost * p + 1 - p)
        assert abs(f.scores(np.array([[v]]), [(200, 5)])[0][0, 1] - want) < 0.01


def test_leaves_hold_enough_rows():
    x, y = rings(200)
    f = shared.Forest(x, y, 2, np.ones(2), 1, 30, 40, 0)
    assert (f.left >= 0).sum() <= 200 / 40


def test_best_cut_equals_the_plain_search():
    """Three weighted classes, empty bins and small nodes; the first of equal cuts wins."""
    rng = np.random.default_rng(5)
    hist, weight = rng.integers(0, 4, (3, 50, shared.BINS)) * rng.integers(0, 2, (3, 50, shared.BINS)), np.array([1.0, 2.5, 0.5])
    gain, at = shared._best_cut(hist, hist.sum(2).T, weight, 12)
    for m in range(50):
        cuts = []
        for b in range(shared.BINS - 1):
            sides = [hist[:, m, :b + 1].sum(1), hist[:, m, b + 1:].sum(1)]
            ok = min(s.sum() for s in sides) >= 12
            cuts.append(sum(((s * weight) ** 2).sum() / (s * weight).sum() for s in sides) if ok else -1.0)
        assert at[m] == int(np.argmax(cuts)) and abs(gain[m] - max(cuts)) < 1e-9


def signals(spark, n=240):
    x, y = rings(n)
    rows = [(k, k // 2, k // 6, int(y[k]), x[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "signal_id long, sample_id long, group_id long, y long, features array<double>")


def test_folds_cover_every_signal_once(spark):
    names = ["PCA-LDA", "SVM-RBF", "RandomForest"]
    got = cv.cv_grid(signals(spark), ["10200X", "10210X"], names, "y", [0, 1], {"rf_ntrees": 20}, k=4, repeats=2)
    counts = got.groupBy("recipe", "classifier", "repeat", "signal_id").count()
    assert counts.count() == 2 * 3 * 2 * 240 and counts.filter("count != 1").count() == 0
    right = {r.classifier: r.a for r in got.groupBy("classifier").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a")).collect()}
    assert min(right["SVM-RBF"], right["RandomForest"]) > 0.8 > right["PCA-LDA"]


def test_blocks_of_models_and_the_bound_on_rows(spark, monkeypatch):
    one = lambda: sorted(map(str, cv.cv_grid(signals(spark), ["10200X"], ["SVM-RBF"], "y", [0, 1], k=3).collect()))
    want = one()
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1000)
    assert one() == want
    monkeypatch.setattr(blocks.fold_predictions, "__defaults__", (100,))
    bounded = one()
    assert len(bounded) == len(want) and bounded != want


def test_grid_points_equal_single_fits(spark):
    df = signals(spark)
    whole = tuning.grid_search(df, "SVM-RBF", "10200X", "y", [0, 1], {"svm_C": (0.1, 10.0), "svm_gamma": (0.1, 1.0)})
    want = {r.variant: r.mean_f2 for r in whole.collect()}
    assert len(want) == 4 and sum(r.is_best for r in whole.collect()) == 1
    alone = tuning.grid_search(df, "SVM-RBF", "10200X", "y", [0, 1], {"svm_C": (10.0,), "svm_gamma": (1.0,)}).collect()
    assert abs(alone[0].mean_f2 - want[alone[0].variant]) < 1e-9


def test_a_block_gets_only_the_rows_of_its_folds(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1000)
    got = cv.cv_grid(signals(spark), ["10200X"], ["SVM-RBF"], "y", [0, 1], k=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("mapinarrow") >= 3 and plan.count("folds") > 2 * plan.count("mapinarrow") and "filter" in plan


def test_fits_take_all_rows(spark):
    """24,000 rows: the predictions are those of models fitted here on every row outside the fold."""
    n = 24_000
    df = signals(spark, n)
    config = {"rf_ntrees": 2, "rf_max_depth": 6, "svm_features": 16}
    got = cv.cv_grid(df, ["10000X"], ["SVM-RBF", "RandomForest"], "y", [0, 1], config, k=2).toPandas()
    assert len(got) == 2 * n
    x, y = rings(n)
    fold = got.drop_duplicates("signal_id").set_index("signal_id").fold.loc[range(n)].to_numpy()
    for f in (1, 2):
        own = np.flatnonzero(fold != f)
        own = own[np.lexsort((*x[own].T[:4], y[own]))]  # the order of the fits
        forest = shared.Forest(x[own], y[own], 2, np.ones(2), 2, 6, 1, 42)
        machine = shared.KernelMachine(x[own], np.where(y[own] == 1, 1.0, -1.0), np.ones(len(own)), "auto", [1.0], 16, 42)
        for name, score in (("RandomForest", lambda x: forest.scores(x, [(2, 6)])[0][:, 1]), ("SVM-RBF", lambda x: 1.0 / (1.0 + np.exp(-2.0 * machine.decision(x)[:, 0])))):
            mine = got[(got.classifier == name) & (got.fold == f)].sort_values("signal_id")
            assert np.allclose(np.stack(mine.scores)[:, 1], score(x[mine.signal_id]), atol=1e-9)


def test_a_forest_in_parts_scores_like_a_whole_one(monkeypatch):
    monkeypatch.setattr(shared, "CELLS", 900)
    x, y = rings(300)
    fit = (x, y, 2, np.ones(2), 10, 8, 2, 5)
    points = [(10, 8), (4, 8), (7, 2)]
    parts = list(shared.Forest.parts(*fit))
    assert [p.trees for p in parts] == [3, 3, 3, 1]
    assert all((a == b).all() for a, b in zip(shared.mean_shares(parts, x, points), shared.Forest(*fit).scores(x, points)))


def test_kernel_machine_is_the_same_in_blocks_of_rows(monkeypatch):
    x, y = rings(300)
    fit = (x, 2.0 * y - 1, np.where(y == 1, 3.0, 1.0), "auto", [0.1, 10.0], 64, 7)
    whole = shared.KernelMachine(*fit)
    monkeypatch.setattr(shared, "MAPPED", 64)
    monkeypatch.setattr(shared, "HELD", 0)
    assert np.allclose(shared.KernelMachine(*fit).decision(x), whole.decision(x), atol=1e-8)
