"""Array transforms, recipes and quality rules on small signals."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavecohort.functions import arrays as A
from wavecohort.functions import batch
from wavecohort.models import linear
from wavecohort.operators import cleaning as C
from wavecohort.operators import quality as Q
from wavecohort.plans import recipes as R

rng = np.random.default_rng(3)


def frame(spark, x, **cols):
    names = list(cols)
    rows = [(i, [float(v) for v in row], *[cols[n][i] for n in names]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "signal_id long, features array<double>" + "".join(
        f", {n} {'string' if isinstance(cols[n][0], str) else 'long'}" for n in names))


def run(spark, x, fn):
    out = frame(spark, x).select("signal_id", fn(F.col("features")).alias("y")).orderBy("signal_id").collect()
    return np.array([r.y for r in out])


def fitted_poly(x, window, poly):
    """Savitzky-Golay by polyfit at every point."""
    h, d = window // 2, len(x)
    out = np.empty(d)
    for i in range(d):
        s = min(max(i - h, 0), d - window)
        c = np.polyfit(np.arange(window), x[s:s + window], poly)
        out[i] = np.polyval(c, i - s)
    return out


def test_binning(spark):
    x = rng.normal(size=(3, 441))
    got = run(spark, x, lambda c: A.bin_signal(c, 4))
    assert got.shape == (3, 110)
    assert np.allclose(got, x[:, :440].reshape(3, 110, 4).mean(axis=2))
    assert np.allclose(run(spark, x[:, :5], lambda c: A.bin_signal(c, 1)), x[:, :5])
    with pytest.raises(Exception, match="bin width"):
        run(spark, x[:, :5], lambda c: A.bin_signal(c, 6))


@pytest.mark.parametrize("window,poly", [(5, 1), (5, 2), (7, 3), (11, 2)])
def test_smoothing(spark, window, poly):
    x = rng.normal(size=(4, 30))
    got = run(spark, x, lambda c: A.sg_smooth(c, window, poly))
    assert np.allclose(got, [fitted_poly(r, window, poly) for r in x], atol=1e-9)
    assert np.allclose(linear.smooth_matrix(30, window, poly) @ x.T, got.T)


def test_smoothing_edges(spark):
    assert np.allclose(run(spark, [[1., 2., 9.]], lambda c: A.sg_smooth(c, 5, 2)), [[1, 2, 9]])
    assert np.allclose(run(spark, np.zeros((1, 12)), lambda c: A.sg_smooth(c, 5, 2)), 0)
    quad = np.array([[0.5 * i * i - 3 * i + 2 for i in range(20)]])
    assert np.allclose(run(spark, quad, lambda c: A.sg_smooth(c, 11, 2)), quad, atol=1e-8)
    for bad in ((4, 2), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            A.sg_smooth(F.col("x"), *bad)


def test_derivative(spark):
    x = rng.normal(size=(2, 25))
    taps = np.array([2, -1, -2, -1, 2]) / 7
    assert np.allclose(batch.derivative_taps(5, 2, 2), taps)
    got = run(spark, x, A.sg_derivative)
    assert np.allclose(got, [np.convolve(r, taps, mode="same") for r in x])
    slope = run(spark, [np.arange(10.)], lambda c: A.sg_derivative(c, 5, 2, 1))
    assert np.allclose(slope[0, 2:-2], 1)
    with pytest.raises(ValueError):
        A.sg_derivative(F.col("x"), 5, 2, 3)


def test_unit_length(spark):
    x = np.vstack([rng.normal(size=6), np.zeros(6), np.full(6, 1e-20)])
    got = run(spark, x, A.l2_normalize)
    assert np.allclose(np.linalg.norm(got[0]), 1) and np.array_equal(got[1:], x[1:])
    assert np.isnan(run(spark, [[1., float("nan")]], A.l2_normalize)[0, 1])


@pytest.mark.parametrize("code,width", [("20000X", 500), ("01000X", 1000), ("10010X", 999), ("10020X", 998), ("10220X", 998), ("21220X", 498)])
def test_recipe_widths(spark, code, width):
    x = rng.normal(size=(8, 1000))
    df = frame(spark, x)
    out, _ = R.recipe_fit_transform(df, code)
    assert R.Recipe(code).width(1000) == width
    assert {r.n for r in out.select(F.size("features").alias("n")).collect()} == {width}


@pytest.mark.parametrize("bad", ["1022X", "10220Y", "a0220X", "102200X"])
def test_recipe_names(bad):
    with pytest.raises(ValueError):
        R.Recipe(bad)


def test_parameters_come_from_training_rows_only(spark):
    train, test = rng.normal(100, 5, (50, 20)), rng.normal(500, 20, (30, 20))
    fitted = R.recipe_fit(frame(spark, train), "10200X")
    got = np.array([r.features for r in fitted.transform(frame(spark, test)).orderBy("signal_id").collect()])
    assert np.allclose(got, (test - train.mean(axis=0)) / train.std(axis=0, ddof=1), atol=1e-10)
    again = R.FittedRecipe.from_row(fitted.to_row(spark))
    assert again == fitted


def test_constant_column_and_guards(spark):
    x = np.column_stack([np.full(5, 3.0), np.arange(5.0)])
    fitted = R.recipe_fit(frame(spark, x), "10200X")
    assert fitted.sigma[0] == 1.0
    with pytest.raises(Exception, match="width"):
        fitted.transform(frame(spark, np.ones((2, 3)))).collect()
    with pytest.raises(Exception, match="finite"):
        fitted.transform(frame(spark, [[1.0, float("inf")]])).collect()
    with pytest.raises(ValueError):
        fitted.transform(frame(spark, x), recipe="10210X")


@pytest.mark.parametrize("code", ["10200X", "10210X", "21220X", "30220X", "02000X"])
def test_recipe_as_affine_map(spark, code):
    """The map used on moments is the transform used on rows."""
    x = rng.normal(3, 2, (40, 36))
    out, _ = R.recipe_fit_transform(frame(spark, x), code)
    got = np.array([r.features for r in out.orderBy("signal_id").collect()])
    stats = linear.Stats(40, x.mean(axis=0), np.cov(x.T) * 39)
    t, offset = linear.recipe_map(R.Recipe(code), stats)
    assert np.allclose(got, x @ t.T + offset, atol=1e-9)


def test_presets_on_zero_and_peak(spark):
    axis = np.linspace(1800, 950, 441)
    x = np.vstack([np.exp(-((axis - 1650) / 20) ** 2), np.zeros(441)])
    p1, p2 = run(spark, x, R.PP1.apply), run(spark, x, R.PP2.apply)
    assert p1.shape == (2, 441) and p2.shape == (2, 110)
    assert not p1[1].any() and not p2[1].any() and np.abs(p1[0]).max() > 0
    with pytest.raises(ValueError):
        R.Preset(smooth=(10, 2))
    with pytest.raises(ValueError):
        R.norm_type(F.col("x"), "other")


def test_quality_values(spark):
    axis = list(np.linspace(1800, 950, 86))
    x = rng.normal(0.5, 0.3, (6, 86))
    x[5] = 0.0
    a = np.array(axis)
    got = Q.signal_quality(frame(spark, x), axis).orderBy("signal_id").collect()
    for row, r in zip(x[:5], got):
        band = row[(a >= 1000) & (a <= 1700)]
        noise = row[(a >= 1750) & (a <= 1800)]
        base = row[((a >= 950) & (a <= 1000)) | ((a >= 1750) & (a <= 1800))]
        assert r.snr == pytest.approx((band.max() - band.min()) / noise.std(ddof=1))
        assert r.baseline_std == pytest.approx(base.std(ddof=1))
        assert r.negative_share == pytest.approx((row < -0.1).mean())
    assert got[5].snr is None and not got[5].ok_snr and not got[5].ok_amide


def test_within_correlation(spark):
    x = rng.normal(size=(9, 15))
    df = frame(spark, x, s=["a"] * 5 + ["b"] * 3 + ["c"])
    got = {r.s: r for r in Q.within_correlation(df, "s").collect()}
    c = np.corrcoef(x[:5])
    assert got["a"].within_corr == pytest.approx(c[np.triu_indices(5, 1)].mean())
    assert got["c"].within_corr is None
    flat = frame(spark, np.vstack([x[:2], np.ones(15)]), s=["a"] * 3)
    assert Q.within_correlation(flat, "s").head().within_corr is None


def test_nan_policies(spark):
    nan = float("nan")
    df = frame(spark, [[1., nan, nan], [3., 4., nan], [5., 8., nan]])
    got = np.array([r.features for r in C.nan_policy(df, "impute").orderBy("signal_id").collect()])
    assert np.allclose(got[:, :2], [[1, 6], [3, 4], [5, 8]]) and np.isnan(got[:, 2]).all()
    assert C.nan_policy(df, "remove").count() == 0
    with pytest.raises(Exception, match="NaN"):
        C.nan_policy(df, "error").collect()
    with pytest.raises(ValueError):
        C.nan_policy(df, "ignore")


def test_nested_means(spark):
    m = rng.normal(size=(4, 5))
    df = spark.createDataFrame([([list(map(float, r)) for r in m],)], "x array<array<double>>")
    row = df.select(A.matrix_mean(F.col("x")).alias("a"), A.matrix_median(F.col("x")).alias("b")).head()
    assert np.allclose(row.a, m.mean(axis=0)) and np.allclose(row.b, np.median(m, axis=0))


def test_batches_of_mixed_lengths_and_missing_values(spark):
    rows = [(0, [1.0] * 9), (1, [2.0] * 4), (2, None), (3, [float("nan")] + [1.0] * 8)]
    df = spark.createDataFrame(rows, "i long, features array<double>").coalesce(1)
    got = {r.i: r.y for r in df.select("i", A.sg_smooth(F.col("features"), 5, 2).alias("y")).collect()}
    assert np.allclose(got[0], 1) and got[1] == [2.0] * 4 and got[2] is None
    assert np.isnan(got[3][:3]).all() and np.allclose(got[3][3:], 1)
    pp2 = {r.i: r.y for r in df.where("i <> 2").select("i", R.PP2.apply(F.col("features")).alias("y")).collect()}
    assert not np.isnan(pp2[3]).any()
    with pytest.raises(ValueError, match="length"):
        batch.features_matrix(pa.array([[1.0, 2.0], [1.0]]))
