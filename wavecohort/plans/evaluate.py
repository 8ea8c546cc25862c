"""Final fit on all training rows and evaluation on the test rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.models.classifiers import fit
from wavecohort.operators import metrics as M
from wavecohort.operators.folds import leakage_guard
from wavecohort.operators.summary import best_configuration


def final_fit_test(train: DataFrame, test: DataFrame, recipe: str, classifier: str, label: str, classes: Sequence,
                   config: Mapping | None = None, group: str = "group_id",
                   keep: Sequence[str] = ("signal_id", "sample_id", "group_id"), features: str = "features"):
    """(model, predictions on the test rows).  Parameters come from the training rows only."""
    leakage_guard(train, test, group)
    model = fit(classifier, recipe, train, label, classes, config, features)
    return model, model.predict(test, keep, label, features)


def best_then_test(summary: DataFrame, metric: str, recipes: Sequence[str], classifiers: Sequence[str], train: DataFrame,
                   test: DataFrame, label: str, classes: Sequence, **options):
    """Pick the best configuration of a cross-validation summary and evaluate it once."""
    row = best_configuration(summary, metric, recipes, classifiers).head()
    if row is None:
        raise ValueError(f"no configuration has a value for {metric}")
    return final_fit_test(train, test, row["recipe"], row["classifier"], label, classes, **options)


def cost_sensitive_fit(classifier: str, recipe: str, train: DataFrame, label: str, classes: Sequence, penalty: float = 5.0,
                       config: Mapping | None = None, features: str = "features"):
    """Penalty for missing the last class: class priors of PCA-LDA, row weights of SVM and forest; PLS ignores it."""
    return fit(classifier, recipe, train, label, classes, {**(config or {}), "cost_penalty": penalty}, features)


def test_report(preds: DataFrame, keys: Sequence[str], positive) -> DataFrame:
    """The nine test metrics as (metric, value) rows."""
    base = M.binary_metrics_npv(preds, keys, positive)
    sens, spec, ppv = F.col("sensitivity"), F.col("specificity"), F.col("ppv")
    wide = base.withColumns({"balanced_accuracy": M.balanced_accuracy(sens, spec), "f2": M.f_beta(ppv, sens)})
    scored = preds.select(*keys, "y_true", F.col("scores")[1].alias("_score"))
    area = M.auc(scored, keys, "_score", F.col("y_true") == F.lit(positive))
    if keys:
        wide = wide.join(area, list(keys))
    else:
        wide = wide.withColumn("_k", F.lit(0)).join(area.withColumn("_k", F.lit(0)), "_k").drop("_k")
    names = ["accuracy", "balanced_accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "f2", "auc"]
    return M.metrics_long(wide, keys, names)
