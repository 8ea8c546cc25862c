"""Grid search by inner cross-validation with an F2 objective."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.models.classifiers import settings
from wavecohort.operators import metrics as M
from wavecohort.plans.cv import Variant, cv_variants

# The searched settings per classifier.
GRIDS = {
    "PLS-DA": {"pls_ncomp": tuple(range(1, 11))},
    "SVM-RBF": {
        "svm_C": tuple(10.0 ** (-2 + 0.5 * i) for i in range(9)),
        "svm_gamma": tuple(10.0 ** (-3 + 0.5 * i) for i in range(9)),
    },
    "RandomForest": {"rf_ntrees": (50, 100, 200, 500), "rf_max_depth": (5, 10, 20, 30)},
}
# The wider search, as points inside the documented ranges.
WIDE_GRIDS = {
    "PCA-LDA": {"lda_delta": (0.0, 0.25, 0.5, 1.0), "lda_gamma": (0.0, 0.25, 0.5, 0.75, 1.0)},
    "PLS-DA": {"pls_ncomp": tuple(range(1, 16))},
    "SVM-RBF": {"svm_C": (0.1, 1.0, 10.0, 100.0), "svm_kernel_scale": (0.001, 0.01, 0.1, 1.0, 10.0)},
    "RandomForest": {"rf_ntrees": (50, 100, 200, 500), "rf_min_leaf_size": (1, 5, 10, 25, 50)},
}


def variants(classifier: str, grid: Mapping[str, Sequence], config: Mapping | None, classes: Sequence) -> list[Variant]:
    """Every combination of the grid, in grid order; ``svm_gamma`` stands for a kernel scale of 1 / sqrt(gamma)."""
    out = []
    for values in product(*grid.values()):
        point = dict(zip(grid, values))
        name = classifier + "".join(f"|{k}={v:g}" for k, v in point.items())
        if "svm_gamma" in point:
            point["svm_kernel_scale"] = point.pop("svm_gamma") ** -0.5
        out.append(Variant(name, classifier, settings({**(config or {}), **point}, classes)))
    return out


def grid_scores(preds: DataFrame, names: Sequence[str], positive) -> DataFrame:
    """(position, name, mean F2 over folds); NULL when a fold has no F2."""
    per_fold = M.binary_metrics_npv(preds, ["classifier", "repeat", "fold"], positive)
    f2 = per_fold.withColumn("f2", M.f_beta(F.col("ppv"), F.col("sensitivity")))
    mean = f2.groupBy("classifier").agg(F.when(F.count("f2") == F.count(F.lit(1)), F.avg("f2")).alias("mean_f2"))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("classifier"))
    return mean.select(order.alias("position"), F.col("classifier").alias("variant"), "mean_f2")


def grid_search(train: DataFrame, classifier: str, recipe: str, label: str, classes: Sequence,
                grid: Mapping[str, Sequence] | None = None, config: Mapping | None = None, k: int = 3, **options) -> DataFrame:
    """Scored grid with the best point marked (the first one on ties).

    A linear classifier's whole grid comes from one pass of moments and one of scoring.
    """
    points = variants(classifier, grid or GRIDS[classifier], config, classes)
    preds = cv_variants(train, [recipe], points, label, classes, k=k, **options)
    scored = grid_scores(preds, [v.name for v in points], classes[-1])
    # one row per grid point
    best = scored.where(F.col("mean_f2").isNotNull()).agg(
        F.min_by("position", F.struct(-F.col("mean_f2"), F.col("position"))).alias("best"))
    one = lambda d: d.withColumn("_k", F.lit(0))
    return one(scored).join(one(best), "_k").select("position", "variant", "mean_f2", (F.col("position") == F.col("best")).alias("is_best"))
