"""Quality control of signals and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecohort.functions import arrays as A
from wavecohort.operators.aggregates import mean_signal, median_points
from wavecohort.operators.outliers import mahalanobis_within

# Axis ranges and limits of the quality rules.
SIGNAL_BAND = (1000.0, 1700.0)
NOISE_BAND = (1750.0, 1800.0)
BASELINE_BANDS = ((950.0, 1000.0), (1750.0, 1800.0))
AMIDE_1_BAND = (1630.0, 1670.0)
AMIDE_2_BAND = (1530.0, 1570.0)
MIN_SNR = 10.0
MAX_ABSORBANCE = 1.8
MAX_BASELINE_STD = 0.02
NEGATIVE_LEVEL = -0.1
AMIDE_RATIO = (1.2, 3.5)
MIN_CORRELATION = 0.85
MIN_VALID = 100


def snr(x: Column, axis: Sequence[float]) -> Column:
    band = A.band_values(x, axis, SIGNAL_BAND)
    noise = A.array_std(A.band_values(x, axis, NOISE_BAND))
    return F.try_divide(F.array_max(band) - F.array_min(band), noise)


def baseline_std(x: Column, axis: Sequence[float]) -> Column:
    return A.array_std(A.band_values(x, axis, *BASELINE_BANDS))


def amide_ratio(x: Column, axis: Sequence[float]) -> Column:
    return F.try_divide(
        F.array_max(A.band_values(x, axis, AMIDE_1_BAND)), F.array_max(A.band_values(x, axis, AMIDE_2_BAND))
    )


def negative_share(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v < NEGATIVE_LEVEL)) / F.size(x).cast("double")


def signal_quality(signals: DataFrame, axis: Sequence[float], features: str = "features",
                   min_snr: float = MIN_SNR, max_absorbance: float = MAX_ABSORBANCE,
                   max_baseline: float = MAX_BASELINE_STD, min_value: float = NEGATIVE_LEVEL,
                   ratio: tuple[float, float] = AMIDE_RATIO) -> DataFrame:
    """Add every per-signal quality value and its pass flag; row-local, no shuffle."""
    x = F.col(features)
    values = signals.withColumns({
        "snr": snr(x, axis),
        "max_value": F.array_max(x),
        "baseline_std": baseline_std(x, axis),
        "min_value": F.array_min(x),
        "negative_share": negative_share(x),
        "amide_ratio": amide_ratio(x, axis),
    })
    ok = lambda c: F.coalesce(c, F.lit(False))
    return values.withColumns({
        "ok_snr": ok(F.col("snr") >= min_snr),
        "ok_saturation": ok(F.col("max_value") <= max_absorbance),
        "ok_baseline": ok(F.col("baseline_std") <= max_baseline),
        "ok_negative": ok(F.col("min_value") >= min_value),
        "ok_amide": ok(F.col("amide_ratio").between(*ratio)),
    })


CHECKS = ("ok_snr", "ok_saturation", "ok_baseline", "ok_amide")


def valid_mask(quality: DataFrame) -> Column:
    """All five rules together."""
    return F.col("ok_snr") & F.col("ok_saturation") & F.col("ok_baseline") & F.col("ok_negative") & F.col("ok_amide")


def qc_funnel(quality: DataFrame, keys: Sequence[str], final: Column | None = None) -> DataFrame:
    """Signals left after each filter, applied in order, per sample."""
    names = ["n_after_snr", "n_after_saturation", "n_after_baseline", "n_after_amide"]
    passed, cols = F.lit(True), []
    for check, name in zip(CHECKS, names):
        passed = passed & F.col(check)
        cols.append(F.sum(passed.cast("long")).alias(name))
    last = passed if final is None else passed & final
    return quality.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_original"), *cols, F.sum(last.cast("long")).alias("n_final")
    )


def qc_rejection_log(quality: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per rejected signal: the first failing filter and the value that failed.

    All rules of ``valid_mask`` count, the negative one last, so the log has one
    row for every signal that the mask rejects.  A column ``ok_distance`` with
    its ``distance`` adds the outlier rule after them.
    """
    # The reason names, in filter order.
    steps = [
        ("ok_snr", "SNR", "snr"), ("ok_saturation", "Saturation", "max_value"),
        ("ok_baseline", "Baseline", "baseline_std"), ("ok_amide", "AmideRatio", "amide_ratio"),
        ("ok_negative", "Negative", "min_value"),
    ]
    if "ok_distance" in quality.columns:
        steps.append(("ok_distance", "Mahalanobis", "distance"))
    reason = value = None
    for check, name, col in steps:
        fail = ~F.col(check)
        reason = F.when(fail, F.lit(name)) if reason is None else reason.when(fail, F.lit(name))
        value = F.when(fail, F.col(col)) if value is None else value.when(fail, F.col(col))
    return quality.select(*keys, reason.alias("reason"), value.alias("qc_value")).where(F.col("reason").isNotNull())


def qc_chain(quality: DataFrame, sample: str, outlier_features: str = "features", max_components: int = 10) -> DataFrame:
    """``quality`` with ``distance`` and ``ok_distance``: rules on single signals first, then outliers among what they left.

    The distance of a signal is that from the valid signals of its sample only,
    so a signal that a rule has rejected moves no limit; such signals have no
    distance and pass the last rule, the log naming the first that failed.
    Rows move once, to their sample, and carry their quality values with them.
    """
    out = mahalanobis_within(quality, sample, quality.columns, max_components, outlier_features, among=valid_mask(quality))
    return out.withColumnRenamed("d2", "distance").withColumn("ok_distance", ~F.col("is_outlier")).drop("is_outlier", "n_components")


def chain_mask(chain: DataFrame) -> Column:
    """All rules of ``qc_chain``."""
    return valid_mask(chain) & F.col("ok_distance")


def within_correlation(signals: DataFrame, sample: str, features: str = "features") -> DataFrame:
    """Mean Pearson correlation over all pairs of signals of a sample, without forming pairs.

    With unit-length centred signals u, the sum over pairs i < j of u_i.u_j is
    (|sum u|^2 - n) / 2, so one vector sum per sample gives the mean.  A
    constant signal has no correlation; its sample gets NULL.
    """
    x = F.col(features)
    centred = A.let(A.array_mean(x), lambda m: F.transform(x, lambda v: v - m))
    unit = A.let(
        centred,
        lambda c: A.let(A.l2_norm(c), lambda n: F.when(n > A.EPS, F.transform(c, lambda v: v / n)).otherwise(c)),
    )
    rows = signals.select(sample, unit.alias("_u"), (A.l2_norm(centred) <= A.EPS).cast("long").alias("_flat"))
    sums = rows.groupBy(sample).agg(
        Summarizer.sum(array_to_vector("_u")).alias("_s"), F.count(F.lit(1)).alias("n"), F.sum("_flat").alias("_n_flat")
    )
    total = A.let(vector_to_array("_s"), lambda s: F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v * v))
    pairs = (F.col("n") * (F.col("n") - 1)).cast("double")
    return sums.select(
        sample, "n",
        F.when((F.col("n") > 1) & (F.col("_n_flat") == 0), (total - F.col("n")) / pairs).alias("within_corr"),
    )


def pairwise_within(signals: DataFrame, sample: str, features: str = "features") -> DataFrame:
    """Number of signal pairs of a sample and the mean and summed correlation over them."""
    pairs = (F.col("n") * (F.col("n") - 1) / 2)
    return within_correlation(signals, sample, features).where(F.col("n") > 1).select(
        sample, pairs.cast("long").alias("n_pairs"), "within_corr", (F.col("within_corr") * pairs).alias("sum_corr")
    )


def flag_low_correlation(corr: DataFrame, limit: float = MIN_CORRELATION) -> DataFrame:
    return corr.withColumn("low_corr", F.coalesce(F.col("within_corr") < limit, F.lit(False)))


def qc_min_valid(quality: DataFrame, keys: Sequence[str], minimum: int = MIN_VALID) -> DataFrame:
    n = F.sum(valid_mask(quality).cast("long"))
    return quality.groupBy(*keys).agg(n.alias("n_valid"), (n < minimum).alias("too_few"))


def qc_filtered_mean(signals: DataFrame, sample: str, keep: Column, features: str = "features") -> DataFrame:
    return mean_signal(signals.where(keep), [sample], features)


def qc_filtered_median(signals: DataFrame, sample: str, keep: Column, features: str = "features") -> DataFrame:
    return median_points(signals.where(keep), [sample], features)


def qc_retention(funnel: DataFrame) -> DataFrame:
    return funnel.withColumn(
        "retention", F.try_divide(F.col("n_final").cast("double"), F.col("n_original").cast("double"))
    )


def snr_histogram(quality: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Signals per SNR bin; bins 0 and ``bins + 1`` hold what lies outside."""
    bucket = F.width_bucket("snr", F.lit(low), F.lit(high), F.lit(bins))
    return quality.groupBy(bucket.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def outlier_removal_summary(flags: DataFrame, flag: str) -> DataFrame:
    removed = F.sum(F.col(flag).cast("long"))
    total = F.count(F.lit(1))
    return flags.agg(
        total.alias("n_total"), removed.alias("n_removed"), (total - removed).alias("n_kept"),
        (F.try_divide(removed.cast("double"), total.cast("double")) * 100.0).alias("percent_removed"),
    )


def session_agreement(points: DataFrame, sample: str, session: str, reference: DataFrame) -> DataFrame:
    """Pearson r between a sample's mean signal in each session and a reference signal (pos, ref)."""
    mean = points.groupBy(sample, session, "pos").agg(F.avg("value").alias("m"))
    return mean.join(reference, "pos").groupBy(sample, session).agg(F.corr("m", "ref").alias("r"))
