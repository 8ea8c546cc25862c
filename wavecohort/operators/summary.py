"""Summaries over a grid of configurations, and tables ready for plotting.

Inputs here have one row per (configuration, repeat, fold); their size is set by
the grid and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavecohort.operators import metrics as M
from wavecohort.operators.aggregates import ci95, mean_std_median

CONFIG = ("recipe", "classifier")
FOLD = ("recipe", "classifier", "repeat", "fold")
# The summarised metrics.
METRICS = ("accuracy", "macro_sensitivity", "macro_specificity", "macro_precision", "macro_f1", "auc")


def fold_metrics(preds: DataFrame, classes: Sequence, group: str = "group_id") -> DataFrame:
    """Metrics per fold at signal and group level."""
    return M.two_level_eval(preds, list(FOLD), group, classes)


def summarize(per_fold: DataFrame, keys: Sequence[str] = ("level", *CONFIG)) -> DataFrame:
    """Mean, std and median of the six metrics over repeats and folds."""
    return mean_std_median(per_fold, list(keys), METRICS)


def to_table(summary: DataFrame) -> DataFrame:
    """The eight-column result table."""
    return summary.select(
        F.col("recipe").alias("Permutation"), F.col("classifier").alias("Classifier"),
        F.col("mean_accuracy").alias("MeanAccuracy"), F.col("std_accuracy").alias("StdAccuracy"),
        F.col("mean_macro_f1").alias("MeanF1"), F.col("std_macro_f1").alias("StdF1"),
        F.col("mean_auc").alias("MeanAUC"), F.col("std_auc").alias("StdAUC"),
    )


def order_in(column: str, values: Sequence[str]) -> Column:
    """Position in the declared order, so that ties go to the configuration listed first."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def best_configuration(summary: DataFrame, metric: str, recipes: Sequence[str], classifiers: Sequence[str]) -> DataFrame:
    ranked = summary.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return ranked.orderBy(F.desc(metric), order_in("recipe", recipes), order_in("classifier", classifiers)).limit(1)


def best_by_metric(summary: DataFrame, metrics: Sequence[str], recipes: Sequence[str], classifiers: Sequence[str]) -> DataFrame:
    """Best configuration per level and metric."""
    long = summary.select("level", *CONFIG, *metrics).unpivot(
        ["level", *CONFIG], list(metrics), "metric", "value"
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    order = F.struct((-F.col("value")).alias("v"), order_in("recipe", recipes).alias("r"),
                     order_in("classifier", classifiers).alias("c"))
    return long.groupBy("level", "metric").agg(F.min_by(F.struct(*CONFIG, "value"), order).alias("b")).select(
        "level", "metric", "b.*"
    )


def heatmap_table(summary: DataFrame, value: str, classifiers: Sequence[str]) -> DataFrame:
    return summary.groupBy("recipe").pivot("classifier", list(classifiers)).agg(F.first(value))


def recipe_comparison(summary: DataFrame, value: str) -> DataFrame:
    return summary.select("recipe", "classifier", F.col(value).alias("value"))


def compare_classifiers(summary: DataFrame, value: str) -> DataFrame:
    """Mean and std of a metric per classifier over the recipes."""
    return summary.groupBy("classifier").agg(
        F.count(value).alias("n_recipes"), F.avg(value).alias("mean_value"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_value"),
    )


def fold_distribution(per_fold: DataFrame, metric: str) -> DataFrame:
    """(config, value) rows for box plots."""
    return per_fold.select(F.concat(F.col("recipe"), F.lit("+"), F.col("classifier")).alias("config"),
                           "repeat", "fold", F.col(metric).alias("value"))


def box_stats(distribution: DataFrame) -> DataFrame:
    names = ["low", "q1", "median", "q3", "high"]
    shares = F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])
    return distribution.where(F.col("value").isNotNull()).groupBy("config").agg(
        F.percentile("value", shares).alias("p"), F.count("value").alias("n")
    ).select("config", "n", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def fold_aggregate(per_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, std and 95 % interval over folds; PPV and NPV without an interval."""
    cols = []
    for m in ("accuracy", "sensitivity", "specificity", "f1"):
        std = F.coalesce(F.stddev_samp(m), F.when(F.count(m) > 0, F.lit(0.0)))
        low, high = ci95(F.avg(m), std, F.count(m))
        cols += [F.avg(m).alias(f"mean_{m}"), std.alias(f"std_{m}"), low.alias(f"ci_low_{m}"), high.alias(f"ci_high_{m}")]
    for m in ("ppv", "npv"):
        cols += [F.avg(m).alias(f"mean_{m}"), F.coalesce(F.stddev_samp(m), F.when(F.count(m) > 0, F.lit(0.0))).alias(f"std_{m}")]
    return per_fold.groupBy(*keys).agg(*cols)


def classifier_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and std of accuracy, sensitivity, specificity, F2 and AUC per classifier; the best F2 is marked."""
    names = ("accuracy", "sensitivity", "specificity", "f2", "auc")
    cols = [c for m in names for c in (
        F.avg(m).alias(f"mean_{m}"), F.coalesce(F.stddev_samp(m), F.when(F.count(m) > 0, F.lit(0.0))).alias(f"std_{m}"))]
    table = per_fold.groupBy("classifier").agg(*cols)
    # one row per classifier
    order = W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("mean_f2"), "classifier")
    return table.withColumn("is_best", F.row_number().over(order) == 1)


def detailed_results(rollup: DataFrame) -> DataFrame:
    """Per-group rows with their fold and interpretation, in report order."""
    return M.flagged(rollup).select(
        "fold", "group_id", "true_label", "pred_label", "correct", "n_rows", "n_low", "n_high", "confidence",
        "mean_p_low", "mean_p_high", "std_p_low", "std_p_high", "entropy", "flag",
    )


def train_test_gap(cv: DataFrame, test: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """CV mean, test value and their difference per metric."""
    keys = ["level", *CONFIG]
    a = cv.select(*keys, *[F.col(f"mean_{m}").alias(m) for m in metrics]).unpivot(keys, list(metrics), "metric", "cv_value")
    b = test.select(*keys, *metrics).unpivot(keys, list(metrics), "metric", "test_value")
    return a.join(b, [*keys, "metric"]).withColumn("gap", F.col("cv_value") - F.col("test_value"))
