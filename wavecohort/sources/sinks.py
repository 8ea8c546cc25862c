"""Writing predictions, summaries and fitted parameters.  Every function runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.operators.summary import to_table


def with_score_columns(preds: DataFrame, n_scores: int, scores: str = "scores") -> DataFrame:
    return preds.select(*[c for c in preds.columns if c != scores],
                        *[F.col(scores)[i].alias(f"score_{i + 1}") for i in range(n_scores)])


def sink_predictions_csv(preds: DataFrame, path: str, n_scores: int) -> None:
    """CSV has no arrays, so each score becomes a column.  One file per task."""
    with_score_columns(preds, n_scores).write.csv(path, header=True, mode="errorifexists")


def sink_summary_csv(summary: DataFrame, path: str) -> None:
    """One row per configuration, so one file."""
    to_table(summary).coalesce(1).write.csv(path, header=True, mode="errorifexists")


def sink_by_classifier(preds: DataFrame, path: str) -> None:
    """Predictions with a ``correct`` flag and the top score, one folder per classifier."""
    out = preds.withColumn("correct", F.col("y_pred") == F.col("y_true"))
    if "scores" in preds.columns:
        out = out.withColumn("confidence", F.array_max("scores"))
    out.write.partitionBy("classifier").parquet(path, mode="errorifexists")


def sink_clean_table(df: DataFrame, path: str) -> None:
    """To a new path only; the source stays as it is."""
    df.write.parquet(path, mode="errorifexists")


def sink_model_params(params: DataFrame, path: str) -> None:
    params.write.parquet(path, mode="errorifexists")
