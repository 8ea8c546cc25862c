"""All result tables of a cross-validation run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.operators import summary as S
from wavecohort.session import cut_lineage
from wavecohort.sources import sinks


def report_tables(preds: DataFrame, classes: Sequence, recipes: Sequence[str], classifiers: Sequence[str],
                  group: str = "group_id") -> dict[str, DataFrame]:
    """Table name -> DataFrame.

    The fold metrics feed every table; they are few rows, so they are written
    once and the predictions are read once.
    """
    per_fold = cut_lineage(S.fold_metrics(preds, classes, group))
    summary = S.summarize(per_fold)
    at = lambda level: summary.where(F.col("level") == level)
    tables = {"fold_metrics": per_fold, "summary": summary,
              "best": S.best_by_metric(summary, ["mean_accuracy", "mean_macro_f1", "mean_auc"], recipes, classifiers)}
    for level in ("signal", "group"):
        tables[f"{level}_results"] = S.to_table(at(level))
        tables[f"{level}_heatmap"] = S.heatmap_table(at(level), "mean_accuracy", classifiers)
        tables[f"{level}_classifiers"] = S.compare_classifiers(at(level), "mean_accuracy")
        tables[f"{level}_recipes"] = S.recipe_comparison(at(level), "mean_accuracy")
        tables[f"{level}_boxes"] = S.box_stats(S.fold_distribution(per_fold.where(F.col("level") == level), "accuracy"))
    return tables


def full_report(preds: DataFrame, path: str, classes: Sequence, recipes: Sequence[str], classifiers: Sequence[str],
                group: str = "group_id") -> dict[str, DataFrame]:
    """Write the tables under ``path``: the two result tables as CSV, the rest as Parquet."""
    tables = report_tables(preds, classes, recipes, classifiers, group)
    for name, df in tables.items():
        if not name.endswith("_results"):
            df.coalesce(1).write.parquet(f"{path}/{name}", mode="errorifexists")
    for level in ("signal", "group"):
        sinks.sink_summary_csv(tables["summary"].where(F.col("level") == level), f"{path}/{level}_results")
    return tables
