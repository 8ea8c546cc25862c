"""Grouped statistics of signals, samples and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavecohort.operators import order_stats
from wavecohort.operators.ordered import group_median, value_ranks
from wavecohort.operators.sets import join_null_safe


def points(signals: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """(keys, pos, value) rows."""
    return signals.select(*keys, F.posexplode(features).alias("pos", "value")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def to_array(per_point: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Gather one value per axis point into an array in axis order; its length is that of the axis."""
    return per_point.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda s: s["v"]).alias(out)
    )


def mean_signal(signals: DataFrame, keys: Sequence[str], features: str = "features", omit_nan: bool = False,
                out: str = "mean_signal") -> DataFrame:
    """Mean signal per key.

    Sums are combined map-side as whole vectors, so one array per key and task is
    shuffled and not one row per axis point.  With ``omit_nan`` the mean of each
    point leaves NaN out; otherwise NaN propagates.
    """
    if omit_nan:
        p = points(signals, keys, features)
        per_point = p.groupBy(*keys, "pos").agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("v"))
        return to_array(per_point, keys, "v", out)
    vec = array_to_vector(F.col(features).cast("array<double>"))
    return signals.groupBy(*keys).agg(Summarizer.mean(vec).alias("_m")).select(
        *keys, vector_to_array(F.col("_m")).alias(out)
    )


def _median_by_points(keys: Sequence[str]):
    return lambda p: group_median(p, [*keys, "pos"], "value", "value")


def median_points(signals: DataFrame, keys: Sequence[str], features: str = "features",
                  gather: int = order_stats.GATHER) -> DataFrame:
    """(keys, pos, median): exact, NaN propagates; a key of more than ``gather`` rows is never in one task."""
    rows = order_stats.point_rows(signals, keys, order_stats.median, _median_by_points(keys), features, gather)
    return rows.withColumnRenamed("value", "median")


def median_signal(signals: DataFrame, keys: Sequence[str], features: str = "features",
                  out: str = "median_signal", gather: int = order_stats.GATHER) -> DataFrame:
    small, large = order_stats.per_key(signals, keys, order_stats.median, _median_by_points(keys), features, gather)
    return small.withColumnRenamed("_values", out).unionByName(to_array(large, keys, "value", out))


def mean_or_median_points(signals: DataFrame, keys: Sequence[str], features: str = "features",
                          gather: int = order_stats.GATHER) -> DataFrame:
    """(keys, pos, value): the mean, or the median of the finite values where the mean is not finite."""

    def by_points(p: DataFrame) -> DataFrame:
        finite = (~F.isnan("value")) & (F.abs("value") < F.lit(float("inf")))
        mean = p.groupBy(*keys, "pos").agg(F.avg("value").alias("m"))
        median = group_median(p.where(finite), [*keys, "pos"], "value")
        ok = (~F.isnan("m")) & (F.abs("m") < F.lit(float("inf")))
        return join_null_safe(mean, median, [*keys, "pos"], "left").select(
            *keys, "pos", F.when(ok, F.col("m")).otherwise(F.col("median")).alias("value")
        )

    return order_stats.point_rows(signals, keys, order_stats.mean_or_median, by_points, features, gather)


def trimmed_mean_points(signals: DataFrame, keys: Sequence[str], trim: float = 0.05, features: str = "features",
                        gather: int = order_stats.GATHER) -> DataFrame:
    """(keys, pos, value): mean of the values whose percent rank lies in [trim, 1 - trim]; points without one are left out."""

    def by_points(p: DataFrame) -> DataFrame:
        ranked = value_ranks(p, [*keys, "pos"], "value")
        share = F.coalesce(F.try_divide(F.col("below").cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0))
        kept = ranked.where((share >= trim) & (share <= 1 - trim) | (F.col("n") == 1))
        return kept.groupBy(*keys, "pos").agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("value"))

    rows = order_stats.point_rows(signals, keys, order_stats.trimmed_mean(trim), by_points, features, gather)
    return rows.where(F.col("value").isNotNull())


def class_counts(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))))


def group_size_stats(df: DataFrame, group: str, member: str | None = None) -> DataFrame:
    """Mean, std, min, max and median of the members per group.

    The median comes from the histogram of sizes, which is small whatever the number of groups.
    """
    size = F.count(F.lit(1)) if member is None else F.countDistinct(member)
    sizes = df.groupBy(group).agg(size.alias("n_members"))
    hist = sizes.groupBy("n_members").agg(F.count(F.lit(1)).alias("w"))
    w, v = F.col("w"), F.col("n_members").cast("double")
    mean = F.sum(v * w) / F.sum(w)
    stats = sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("n_members").alias("mean_size"),
        F.coalesce(F.stddev_samp("n_members"), F.lit(0.0)).alias("std_size"),
        F.min("n_members").alias("min_size"), F.max("n_members").alias("max_size"),
    )
    below = F.sum("w").over(W.partitionBy(F.lit(0)).orderBy("n_members"))
    total = F.sum("w").over(W.partitionBy(F.lit(0)))
    med = hist.select("n_members", "w", below.alias("upto"), total.alias("total"))
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("n_members")))
    med = med.agg(((at(lo) + at(hi)) / 2.0).alias("median_size"))
    return stats.withColumn("_k", F.lit(0)).join(med.withColumn("_k", F.lit(0)), "_k").drop("_k")


def feature_ranges(signals: DataFrame, features: str = "features") -> DataFrame:
    return points(signals, [], features).groupBy("pos").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_value"),
    )


def count_distinct_groups(df: DataFrame, group: str, sample: str) -> DataFrame:
    return df.agg(F.countDistinct(group).alias("n_groups"), F.countDistinct(sample).alias("n_samples"))


def dataset_summary(df: DataFrame, split: str, label: str, group: str, n_spectra: Column) -> DataFrame:
    """Totals per (split, label), per split and overall ('all' where a level is rolled up)."""
    return df.rollup(split, label).agg(
        F.grouping(split).alias("_gs"), F.grouping(label).alias("_gl"),
        F.count(F.lit(1)).alias("n_samples"), F.countDistinct(group).alias("n_groups"),
        F.sum(n_spectra).cast("long").alias("n_spectra"),
    ).select(
        F.when(F.col("_gs") == 1, F.lit("all")).otherwise(F.col(split).cast("string")).alias(split),
        F.when(F.col("_gl") == 1, F.lit("all")).otherwise(F.col(label).cast("string")).alias(label),
        "n_samples", "n_groups", "n_spectra",
    )


def majority_label(df: DataFrame, keys: Sequence[str], label: str, out: str = "label") -> DataFrame:
    """Most frequent label, the smallest on ties.  Labels are counted first, so a large group costs one row per label."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(out))


def mean_std_median(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Summary of metric columns over the folds of a configuration, leaving NaN and NULL out.

    A group here has one row per (repeat, fold), so the exact median is cheap.
    """
    cols = []
    for m in metrics:
        v = F.when(~F.isnan(m), F.col(m))
        cols += [
            F.avg(v).alias(f"mean_{m}"),
            F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"std_{m}"),
            F.median(v).alias(f"median_{m}"),
        ]
    return df.groupBy(*keys).agg(*cols)


def ci95(mean: Column, std: Column, n: Column) -> tuple[Column, Column]:
    # Fixed value: normal quantile of a 95 % interval.
    half = F.lit(1.96) * F.try_divide(std, F.sqrt(n.cast("double")))
    return mean - half, mean + half


def percentile_ci(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """2.5 and 97.5 percentiles over repeats (linear interpolation)."""
    return df.groupBy(*keys).agg(F.percentile(metric, F.array(F.lit(0.025), F.lit(0.975))).alias("p")).select(
        *keys, F.col("p")[0].alias("ci_low"), F.col("p")[1].alias("ci_high")
    )


def split_demographics(df: DataFrame, split: str, age: str, sex: str, label: str, cluster: str,
                       sexes: Sequence[str], labels: Sequence, clusters: Sequence[str]) -> DataFrame:
    """Age statistics and counts by sex, class and methylation cluster per split, in one pass."""
    counted = [F.sum((F.col(sex) == s).cast("long")).alias(f"n_sex_{s}") for s in sexes]
    counted += [F.sum((F.col(label) == v).cast("long")).alias(f"n_label_{v}") for v in labels]
    counted += [F.sum((F.col(cluster) == c).cast("long")).alias(f"n_cluster_{c}") for c in clusters]
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(age).alias("age_mean"), F.stddev_samp(age).alias("age_std"),
        F.min(age).alias("age_min"), F.max(age).alias("age_max"), *counted,
    )


def lag_diff(long: DataFrame, signal: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """First difference in long form; a window holds one signal, so at most the axis length."""
    w = W.partitionBy(signal).orderBy(pos)
    return long.select(signal, pos, (F.col(value) - F.lag(value).over(w)).alias("diff")).where(F.col("diff").isNotNull())
