"""Row-local transforms of one signal (``array<double>`` in, array or scalar out).

Built-in higher-order functions, apart from the two Savitzky-Golay filters,
which run on Arrow batches.  No shuffle, and usable unchanged on a streaming
DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavecohort.functions import batch
from wavecohort.functions.batch import EPS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A subexpression used twice, or inside a lambda, is re-evaluated each time, so
    chained transforms would cost a product of their lengths.  Binding it as the
    variable of a one-element ``transform`` avoids that.
    """
    return F.transform(F.array(value), body)[0]


def doubles(values: Sequence[float]) -> Column:
    """A constant array as one literal.

    ``array(lit, lit, ...)`` would put every number into the plan, and planning
    would pay for each of them; a split text folds to a single constant.
    """
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")



def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(x: Column) -> Column:
    return let(x, lambda s: F.try_divide(array_sum(s), F.size(s).cast("double")))


def array_std(x: Column) -> Column:
    """Sample standard deviation of the elements; 0 for one element, NULL for none."""
    def squares(s: Column, m: Column) -> Column:
        return F.aggregate(s, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))

    def deviation(s: Column) -> Column:
        spread = let(array_mean(s), lambda m: squares(s, m))
        return F.when(F.size(s) > 1, F.sqrt(F.try_divide(spread, F.size(s) - 1.0))).when(F.size(s) == 1, F.lit(0.0))

    return let(x, deviation)


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))


def l2_normalize(x: Column) -> Column:
    """x / ||x||; a signal whose norm is not finite or below machine epsilon is returned as it is."""
    usable = lambda n: (~F.isnan(n)) & (n < F.lit(float("inf"))) & (n >= F.lit(EPS))
    scaled = lambda s, n: F.when(usable(n), F.transform(s, lambda v: v / n)).otherwise(s)
    return let(x, lambda s: let(l2_norm(s), lambda n: scaled(s, n)))


def bin_signal(x: Column, width: int, omit_nan: bool = False) -> Column:
    """Mean of consecutive ``width`` points; a shorter tail is dropped."""
    if width < 1:
        raise ValueError("bin width must be at least 1")
    if width == 1:
        return x

    def one(s: Column, i: Column) -> Column:
        part = F.slice(s, i * width + 1, F.lit(width))
        if omit_nan:
            kept = F.filter(part, lambda v: ~F.isnan(v))
            return F.coalesce(array_mean(kept), F.lit(float("nan")))
        return array_sum(part) / F.lit(float(width))

    def binned(s: Column) -> Column:
        last = F.floor(F.size(s) / F.lit(width)).cast("int") - 1
        return F.when(last < 0, F.raise_error(F.lit("bin width exceeds the signal length"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: one(s, i))
        )

    return let(x, binned)


def check_window(window: int, poly: int, order: int = 0) -> None:
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be a positive odd number")
    if poly < 0 or poly >= window:
        raise ValueError("polynomial order must be non-negative and below the window")
    if order < 0 or order > poly:
        raise ValueError("derivative order must be between 0 and the polynomial order")


def sg_smooth(x: Column, window: int, poly: int) -> Column:
    """Savitzky-Golay smoothing; edge points come from the fit of the first / last full window.

    A signal shorter than the window is returned unchanged.
    """
    check_window(window, poly)
    return batch.batch_column(x, lambda m: batch.smooth(m, window, poly))


def sg_derivative(x: Column, window: int = 5, poly: int = 2, order: int = 2) -> Column:
    """Local-polynomial derivative with unit spacing; outside the signal counts as zero."""
    check_window(window, poly, order)
    return batch.batch_column(x, lambda m: batch.derivative(m, window, poly, order))


def diff_signal(x: Column, order: int = 1) -> Column:
    """``order`` times the first difference; the result is ``order`` points shorter."""
    if order < 0:
        raise ValueError("difference order must not be negative")
    for _ in range(order):
        x = let(
            x,
            lambda s: F.zip_with(
                F.slice(s, F.lit(2), F.size(s) - 1), F.slice(s, F.lit(1), F.size(s) - 1), lambda a, b: a - b
            ),
        )
    return x


def zscore_apply(x: Column, mu: Column, sigma: Column) -> Column:
    return F.zip_with(F.zip_with(x, mu, lambda a, m: a - m), sigma, lambda a, s: a / s)


def nonfinite_count(x: Column) -> Column:
    bad = lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.size(F.filter(x, bad)).cast("long")


def has_nan(x: Column) -> Column:
    return F.exists(x, lambda v: F.isnan(v) | v.isNull())


def dot(x: Column, weights: Column) -> Column:
    return array_sum(F.zip_with(x, weights, lambda a, b: a * b))


# --- scores -----------------------------------------------------------------


def sigmoid_scores(decision: Column) -> Column:
    """One decision value -> [1 - p, p]."""
    return let(F.lit(1.0) / (F.lit(1.0) + F.exp(-decision)), lambda p: F.array(F.lit(1.0) - p, p))


def softmax_scores(values: Column) -> Column:
    shifted = let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    return share_scores(shifted)


def share_scores(values: Column) -> Column:
    return let(array_sum(values), lambda total: F.transform(values, lambda v: v / total))


def distance_scores(fit: Column, n_classes: int) -> Column:
    """Closeness exp(-|fit - i|) to each class number 1..K, normalised to sum 1."""
    centres = F.array(*[F.lit(float(i)) for i in range(1, n_classes + 1)])
    return share_scores(F.transform(centres, lambda c: F.exp(-F.abs(fit - c))))


def round_clamp_class(fit: Column, n_classes: int) -> Column:
    """Nearest class number, halves away from zero, kept within 1..K."""
    return F.greatest(F.lit(1), F.least(F.lit(n_classes), F.round(fit).cast("long"))).cast("long")


def entropy_bits(*probabilities: Column) -> Column:
    total = None
    for p in probabilities:
        term = p * F.log2(p + F.lit(EPS))
        total = term if total is None else total + term
    return -total


# --- axis bands ---------------------------------------------------------------


def band_positions(axis: Sequence[float], low: float, high: float) -> list[int]:
    """Positions of the axis points inside [low, high]."""
    return [i for i, a in enumerate(axis) if low <= a <= high]


def band_values(x: Column, axis: Sequence[float], *ranges: tuple[float, float]) -> Column:
    """Values inside the union of the ranges.

    The axis is fixed per dataset, so a band is a few slices and no join; it may
    run in either direction.
    """
    keep = sorted({p for low, high in ranges for p in band_positions(axis, low, high)})
    if not keep:
        raise ValueError("no axis point lies in the requested range")
    runs: list[list[int]] = []
    for p in keep:
        if runs and p == runs[-1][-1] + 1:
            runs[-1].append(p)
        else:
            runs.append([p])
    parts = [F.slice(x, F.lit(r[0] + 1), F.lit(len(r))) for r in runs]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


# --- nested samples -------------------------------------------------------------


def matrix_mean(rows: Column) -> Column:
    """Column means of a small matrix held in one row; NaN propagates."""
    first = F.get(rows, F.lit(0))
    total = F.aggregate(
        F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), first,
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )
    return let(F.size(rows).cast("double"), lambda n: F.transform(total, lambda v: v / n))


def matrix_median(rows: Column) -> Column:
    """Column medians of a small matrix held in one row; NaN propagates."""
    n = F.size(rows)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")

    def one(i: Column) -> Column:
        return let(
            F.array_sort(F.transform(rows, lambda x: F.get(x, i))),
            lambda s: F.when(F.isnan(F.get(s, n - 1)), F.lit(float("nan"))).otherwise((F.get(s, lo) + F.get(s, hi)) / 2.0),
        )

    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), one)
