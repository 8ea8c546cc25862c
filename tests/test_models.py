"""Fits from moments against plain numpy, and classifiers on separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.models import classifiers as M
from wavecohort.models import linear
from wavecohort.models.regression import pls_regress
from wavecohort.operators import outliers as O
from wavecohort.operators import summary as S
from wavecohort.operators.moments import moments
from wavecohort.plans import cv, evaluate, recipes, report, tuning

rng = np.random.default_rng(11)


def table(spark, n=120, d=12, gap=1.0, offset=50.0, per_group=4):
    rows = []
    for i in range(n):
        y = 1 if i % 2 == 0 else 3
        x = rng.normal(offset + (gap if y == 3 else -gap), 1.0, d)
        rows.append((i, (i // 2) // per_group * 2 + i % 2, y, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "signal_id long, group_id long, label long, features array<double>")
    return df.withColumn("sample_id", F.col("group_id")), np.array([r[3] for r in rows]), np.array([r[2] for r in rows])


def test_moments_identity(spark):
    df, x, y = table(spark, 200)
    got = O.stats_rows(moments(df.repartition(7), ["label"]), ["label"])
    for c in (1, 3):
        s = got[(c,)]
        assert s.n == (y == c).sum() and np.allclose(s.mean, x[y == c].mean(axis=0))
        assert np.allclose(s.scatter, np.cov(x[y == c].T) * (s.n - 1))
    whole = linear.pooled(list(got.values()))
    assert np.allclose(whole.scatter, np.cov(x.T) * (len(x) - 1)) and np.allclose(whole.mean, x.mean(axis=0))
    parted = O.stats_rows(moments(df, ["label"], gather=7), ["label"])
    assert np.allclose(parted[(3,)].scatter, got[(3,)].scatter)


def test_moments_far_from_zero_lose_nothing(spark):
    df, x, y = table(spark, 200)
    far = df.withColumn("features", F.transform("features", lambda v: v + 1e6))
    got = O.stats_rows(moments(far.repartition(9), ["label"]), ["label"])
    for c in (1, 3):
        assert np.allclose(got[(c,)].scatter, np.cov(x[y == c].T) * ((y == c).sum() - 1), rtol=1e-6)


def test_moments_by_fold(spark):
    df, x, y = table(spark, 96)
    folds = cv.stratified_group_folds(df, "group_id", "label", 3, 2)
    rows = cv.with_folds(df, folds, "group_id", 2)
    local = rows.select("signal_id", "folds").toPandas().sort_values("signal_id")
    f = np.array(local["folds"].tolist())
    got = O.stats_rows(moments(rows, ["label"], fold_array="folds"), ["label", "repeat", "fold"])
    assert len(got) == 12
    for (c, r, k), s in got.items():
        part = x[(y == c) & (f[:, r - 1] == k)]
        assert s.n == len(part) and np.allclose(s.mean, part.mean(axis=0))
        assert np.allclose(s.scatter, (part - part.mean(axis=0)).T @ (part - part.mean(axis=0)))


def test_pca(spark):
    df, x, _ = table(spark)
    fit = O.pca(df, 0.95, 6)
    centred = x - x.mean(axis=0)
    _, sv, vt = np.linalg.svd(centred, full_matrices=False)
    explained = 100 * sv ** 2 / (sv ** 2).sum()
    k = min(int(np.argmax(np.cumsum(explained) >= 95)) + 1, 6)
    assert len(fit.explained) == k and np.allclose(fit.explained, explained[:k])
    got = np.array([r.pc for r in O.project(df, ["signal_id"], fit.mean, fit.coeff).orderBy("signal_id").collect()])
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:k].T), atol=1e-8)


def test_lda_against_direct_formula(spark):
    df, x, y = table(spark, 160, 8, 0.4)
    model = M.fit("PCA-LDA", "10200X", df, "label", [1, 3], {"pca_variance_threshold": 1.1, "pca_max_components": 8})
    got = model.predict(df, ["signal_id"], "label").orderBy("signal_id").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    m1, m3 = z[y == 1].mean(axis=0), z[y == 3].mean(axis=0)
    sw = sum((z[y == c] - m).T @ (z[y == c] - m) for c, m in ((1, m1), (3, m3))) / (len(z) - 2)
    w = np.linalg.solve(sw, m3 - m1)
    logit = (z - (m1 + m3) / 2) @ w + np.log((y == 3).sum() / (y == 1).sum())
    assert np.allclose([r.scores[1] for r in got], 1 / (1 + np.exp(-logit)), atol=1e-8)
    assert [r.y_pred for r in got] == list(np.where(logit > 0, 3, 1))


def nipals(x, y, n):
    """Textbook PLS1 by deflation."""
    e, f = x - x.mean(axis=0), y - y.mean()
    ws, ps, qs = [], [], []
    for _ in range(n):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.solve(p.T @ w, np.array(qs))


@pytest.mark.parametrize("n", [1, 3, 6])
def test_pls_against_nipals(spark, n):
    df, x, y = table(spark, 150, 10, 0.5)
    model = M.fit("PLS-DA", "10200X", df, "label", [1, 3], {"pls_ncomp": n})
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    num = np.where(y == 3, 2.0, 1.0)
    want = num.mean() + (z - z.mean(axis=0)) @ nipals(z, num, n)
    got = x @ model.model.weights[:, 0] + model.model.intercept[0]
    assert np.allclose(got, want, atol=1e-8)


def test_multi_response_pls(spark):
    df, x, y = table(spark, 150, 5)
    resp = np.column_stack([x @ [1, 2, 0, 0, -1.0] + rng.normal(size=len(x)), x @ [0, 0, 1, 1, 1.0]])
    both = spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, resp))],
                                 "id long, features array<double>, responses array<double>")
    fit = pls_regress(both, 5)
    beta, *_ = np.linalg.lstsq(x - x.mean(axis=0), resp - resp.mean(axis=0), rcond=None)
    assert np.allclose(fit.pls.beta, beta, atol=1e-8)
    assert np.allclose(pls_regress(both, 3, responses=None).mean, x.mean(axis=0))
    t = np.array([r.t for r in fit.x_scores(both, ["id"]).orderBy("id").collect()])
    assert np.allclose(t.T @ t, np.eye(5), atol=1e-8)


def test_priors_and_shrinkage():
    assert linear.weighted_priors({1: 6, 3: 2}, 3, 5.0) == {1: 6 / 16, 3: 10 / 16}
    parts = {1: linear.Stats(10, np.zeros(2), np.array([[9.0, 4.0], [4.0, 9.0]])),
             3: linear.Stats(10, np.ones(2), np.array([[9.0, 4.0], [4.0, 9.0]]))}
    w, _ = linear.lda_weights(parts, gamma=1.0)
    assert np.allclose(w[:, 1], 0.5)
    w, _ = linear.lda_weights(parts, delta=10.0)
    assert not w.any()


SMALL = {"rf_ntrees": 15, "rf_max_depth": 4, "svm_features": 64, "max_iter": 15}


@pytest.mark.parametrize("name", M.CLASSIFIERS)
def test_separable_classes(spark, name):
    df, _, _ = table(spark, 100, 10, 2.0, offset=0.0)
    config = {k: v for k, v in SMALL.items()}
    train, test = df.where("group_id % 3 <> 0"), df.where("group_id % 3 = 0")
    model, preds = evaluate.final_fit_test(train, test, "10200X", name, "label", [1, 3], config)
    rows = preds.collect()
    assert np.mean([r.y_pred == r.y_true for r in rows]) > 0.9
    assert all(abs(sum(r.scores) - 1) < 1e-9 and min(r.scores) >= 0 for r in rows)
    again = {r.signal_id: r.scores for r in model.predict(test, ["signal_id"], "label").collect()}
    assert all(np.allclose(again[r.signal_id], r.scores) for r in rows)


def test_interface_errors(spark):
    df, _, _ = table(spark, 40, 5)
    with pytest.raises(ValueError, match="unknown classifier"):
        M.fit("KNN", "10200X", df, "label", [1, 3])
    with pytest.raises(ValueError, match="unknown setting"):
        M.fit("PCA-LDA", "10200X", df, "label", [1, 3], {"svm_c": 1})
    assert M.settings({"rf_n_trees": 7}, [1, 3])["rf_ntrees"] == 7
    model = M.fit("PCA-LDA", "10200X", df, "label", [1, 3])
    wrong = df.withColumn("features", F.slice("features", 1, 4))
    with pytest.raises(Exception):
        model.predict(wrong, ["signal_id"], "label").collect()
    with pytest.raises(ValueError, match="both"):
        evaluate.final_fit_test(df, df, "10200X", "PCA-LDA", "label", [1, 3])


def test_cost_penalty_favours_the_positive_class(spark):
    df, _, _ = table(spark, 200, 6, 0.15, offset=0.0)
    for name in ("PCA-LDA", "SVM-RBF"):
        plain = M.fit(name, "10200X", df, "label", [1, 3], SMALL).predict(df, ["signal_id"], "label")
        heavy = evaluate.cost_sensitive_fit(name, "10200X", df, "label", [1, 3], 5.0, SMALL).predict(df, ["signal_id"], "label")
        positives = lambda p: p.where(F.col("y_pred") == 3).count()
        assert positives(heavy) > positives(plain)


def test_cv_equals_fit_on_the_other_folds(spark):
    """Scoring from fold moments is the same as fitting each fold by itself."""
    df, _, _ = table(spark, 96, 9, 0.4)
    folds = cv.stratified_group_folds(df, "group_id", "label", 3, 1)
    preds = cv.cv_grid(df, ["21210X"], ["PCA-LDA", "PLS-DA"], "label", [1, 3], k=3, folds=folds).cache()
    assert preds.count() == 96 * 2
    rows = cv.with_folds(df, folds, "group_id", 1)
    for kind in ("PCA-LDA", "PLS-DA"):
        inside = F.col("folds")[0] == 2
        model = M.fit(kind, "21210X", rows.where(~inside), "label", [1, 3])
        want = {r.signal_id: r.scores for r in model.predict(rows.where(inside), ["signal_id"], "label").collect()}
        got = {r.signal_id: r.scores for r in preds.where((F.col("fold") == 2) & (F.col("classifier") == kind)).collect()}
        assert want.keys() == got.keys() and all(np.allclose(want[i], got[i], atol=1e-8) for i in want)


def test_end_to_end_with_mllib(spark, tmp_path):
    rows = []
    for g in range(12):
        for s in range(3):
            x = rng.normal(1 if g % 2 else -1, 0.6, 20)
            rows.append((g * 3 + s, g, 1 + g % 2, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "signal_id long, group_id long, label long, features array<double>").withColumn("sample_id", F.col("signal_id"))
    recipes_, names = ["10200X", "10220X"], ["PCA-LDA", "PLS-DA"]
    preds = cv.cv_grid(df, recipes_, names, "label", [1, 2], k=3, repeats=2).cache()
    assert preds.count() == 36 * 2 * 4
    out = report.full_report(preds, str(tmp_path / "r"), [1, 2], recipes_, names)
    summary = out["summary"].where("level = 'signal'")
    assert summary.count() == 4
    best = S.best_configuration(summary, "mean_accuracy", recipes_, names).head()
    assert best.mean_accuracy > 0.4
    assert spark.read.csv(str(tmp_path / "r" / "group_results"), header=True).count() == 4
    forest = cv.cv_grid(df, ["10200X"], ["RandomForest"], "label", [1, 2], SMALL, k=2)
    assert forest.count() == 36 and forest.where("y_true = y_pred").count() > 30


def test_grid_search_marks_one_best(spark):
    df, _, _ = table(spark, 96, 8, 0.5)
    out = tuning.grid_search(df, "PLS-DA", "10200X", "label", [1, 3], {"pls_ncomp": (1, 2, 3)}).orderBy("position").collect()
    assert [r.position for r in out] == [1, 2, 3] and sum(r.is_best for r in out) == 1
    top = max(r.mean_f2 for r in out)
    assert next(r for r in out if r.is_best).mean_f2 == top
    assert len(tuning.variants("SVM-RBF", tuning.GRIDS["SVM-RBF"], None, [1, 3])) == 81


def test_within_sample_distance(spark):
    x = rng.normal(size=(30, 4))
    x[7] += 25.0
    df = spark.createDataFrame([(0 if i < 20 else 1, i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "sample_id long, signal_id long, features array<double>")
    got = {r.signal_id: r for r in O.mahalanobis_within(df, "sample_id", ["signal_id"]).collect()}
    part = x[:20]
    inv = np.linalg.inv(np.cov(part.T))
    for i in range(20):
        z = part[i] - part.mean(axis=0)
        assert got[i].d2 == pytest.approx(z @ inv @ z)
    assert [i for i, r in got.items() if r.is_outlier] == [7]


def test_within_sample_distance_by_rows_equals_that_by_moments(spark):
    sizes = {None: 5, 0: 2, 1: 9, 2: 40, 3: 1}  # fewer and more signals than points, too few, a null sample
    rows = [(k, 100 * i + j, [float(v) for v in rng.normal(size=12)], j % 4 != 0) for i, (k, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, signal_id long, features array<double>, fine boolean")
    by_rows, by_moments = ({r.signal_id: r for r in O.mahalanobis_within(df, "sample_id", ["signal_id"], gather=g).collect()} for g in (10**6, 0))
    assert len(by_rows) == len(by_moments) == len(rows)
    for i, r in by_rows.items():
        assert r.d2 == pytest.approx(by_moments[i].d2, abs=1e-6)
        assert (r.n_components, r.is_outlier) == (by_moments[i].n_components, by_moments[i].is_outlier)
    part = {r.signal_id: r for r in O.mahalanobis_within(df, "sample_id", ["signal_id"], among=df["fine"]).collect()}
    alone = {r.signal_id: r for r in O.mahalanobis_within(df.where("fine"), "sample_id", ["signal_id"]).collect()}
    for k, i, _, fine in rows:
        if fine:
            assert part[i].d2 == pytest.approx(alone[i].d2, abs=1e-9)
        else:
            assert part[i].d2 is None and part[i].is_outlier is False


def test_quality_chain_finds_outliers_among_valid_signals_only(spark):
    from wavecohort.operators import quality as Q

    names = ["ok_snr", "ok_saturation", "ok_baseline", "ok_negative", "ok_amide"]
    x = rng.normal(size=(60, 3))
    x[5], x[6] = 30.0, -4000.0  # an outlier, and a far one that a rule rejects and that would hide it
    rows = [(i, i % 2, [float(v) for v in r], *[i != 6] * 5, 1.0, 1.0, 1.0, 1.0, 1.0) for i, r in enumerate(x)]
    values = ["snr", "max_value", "baseline_std", "amide_ratio", "min_value"]
    df = spark.createDataFrame(rows, "signal_id long, sample_id long, features array<double>, " + ", ".join(
        [f"{n} boolean" for n in names] + [f"{n} double" for n in values]))
    chain = Q.qc_chain(df, "sample_id").cache()
    log = {r.signal_id: r.reason for r in Q.qc_rejection_log(chain, ["signal_id"]).collect()}
    assert log == {5: "Mahalanobis", 6: "SNR"}
    funnel = Q.qc_funnel(chain, ["sample_id"], F.col("ok_negative") & F.col("ok_distance")).collect()
    assert sum(r.n_original - r.n_final for r in funnel) == len(log)
    means = {r.sample_id: r.mean_signal for r in Q.qc_filtered_mean(chain, "sample_id", Q.chain_mask(chain)).collect()}
    for s in (0, 1):
        assert np.allclose(means[s], np.mean([v for i, v in enumerate(x) if i % 2 == s and i not in (5, 6)], axis=0))


def test_t2_q_and_class_outliers(spark):
    x = rng.normal(size=(200, 6)) * [5, 4, 3, 1, .1, .1]
    x[3] += [60, 0, 0, 0, 30, 0]
    df = spark.createDataFrame([(i, 1 + i % 2, [float(v) for v in r]) for i, r in enumerate(x)],
                               "signal_id long, label long, features array<double>")
    out = O.t2_q_outliers(df, ["signal_id"], 3).collect()
    assert all(r.t2 >= 0 and r.q >= -1e-9 for r in out)
    by_class = O.mahalanobis_by_class(df, "label", ["signal_id"]).collect()
    removed = [r.signal_id for r in by_class if r.is_removed]
    assert 3 in removed and len(removed) <= 2
    info = O.mahalanobis_test_info(df, df.limit(10), "label", ["signal_id"]).collect()
    assert len(info) == 10


def test_pca_standardized_keeps_sigma(spark):
    df, x, _ = table(spark, 80, 5)
    fit, sigma = O.pca_standardized(df, 1.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(sigma, x.std(axis=0, ddof=1))
    got = np.array([r.pc for r in O.project(df, ["signal_id"], fit.mean, fit.coeff).orderBy("signal_id").collect()])
    assert np.allclose((got ** 2).sum(axis=1), (z ** 2).sum(axis=1))


def test_models_read_back_predict_the_same(spark, tmp_path):
    from wavecohort.models import store
    rng = np.random.default_rng(8)
    rows = [(i, "low" if i % 2 else "high", [float(v) for v in rng.normal(i % 2, 1.0, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "signal_id long, y string, features array<double>")
    quick = {"rf_ntrees": 5, "max_iter": 10, "svm_features": 16}
    for k, (name, conf) in enumerate([("PCA-LDA", {}), ("PLS-DA", {}), ("RandomForest", quick), ("SVM-RBF", quick),
                                      ("SVM-RBF", {**quick, "svm_platt": True}), ("Logistic", quick)]):
        model = M.fit(name, "10210X", df, "y", ["low", "high"], conf)
        path = str(tmp_path / f"m{k}")
        store.save_model(spark, model, path)
        want, got = [{r.signal_id: r for r in m.predict(df, ["signal_id"], "y").collect()}
                     for m in (model, store.load_model(spark, path))]
        assert got == want and len(got) == 60
        with pytest.raises(Exception):
            store.save_model(spark, model, path)


def test_line_summary_stores_no_row_ids(spark, sf, monkeypatch):
    from wavecohort.catalog import fits

    stored = []
    monkeypatch.setattr(fits, "cut_lineage", lambda df, *name: stored.append(df.columns) or df)
    fits.cv_summary_lines(spark, sf)
    assert stored == [["recipe", "classifier", "repeat", "fold", "group_id", "y_true", "y_pred", "scores"]]
