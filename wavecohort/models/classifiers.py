"""One interface over all classifiers: ``fit`` gives a model with ``predict(df)``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.models import linear, mllib
from wavecohort.models.linear import LinearModel, Stats
from wavecohort.functions.batch import features_matrix, list_array
from wavecohort.operators.moments import moments
from wavecohort.plans.recipes import Recipe, recipe_fit

LINEAR = ("PCA-LDA", "PLS-DA", "PLS-PM1")
MLLIB = {"SVM-RBF": mllib.svm_fit, "RandomForest": mllib.forest_fit, "Logistic": mllib.logistic_fit}
CLASSIFIERS = (*LINEAR, *MLLIB)

# Default settings of the classifiers.
DEFAULTS = {
    "pca_variance_threshold": 0.95,
    "pca_max_components": 15,
    "lda_gamma": 0.0,
    "lda_delta": 0.0,
    "pls_ncomp": 10,
    "svm_C": 1.0,
    "svm_kernel_scale": "auto",
    "svm_features": 256,
    "svm_platt": False,
    "rf_ntrees": 100,
    "rf_min_leaf_size": 1,
    "rf_max_depth": 10,
    "max_iter": 100,
    "seed": 42,
    "cost_penalty": None,
    "positive": None,
}
ALIASES = {"plsda_n_components": "pls_ncomp", "rf_n_trees": "rf_ntrees"}


def settings(config: Mapping | None, classes: Sequence) -> dict:
    """Defaults overridden by ``config``; unknown names are an error."""
    out = dict(DEFAULTS, positive=classes[-1])
    for name, value in (config or {}).items():
        name = ALIASES.get(name, name)
        if name not in out and name != "lr_reg":
            raise ValueError(f"unknown setting: {name}")
        out[name] = value
    return out


def check_name(classifier: str) -> None:
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier!r}; choose one of {', '.join(CLASSIFIERS)}")


def class_stats(train: DataFrame, label: str, classes: Sequence, features: str = "features") -> dict:
    """Statistics per declared class; other labels are left out.  One pass; the result is one d x d matrix per class."""
    rows = moments(train.where(F.col(label).isin(list(classes))), [label], features).toArrow()
    return {
        rows.column(label)[i].as_py(): Stats.of(
            rows.column("n")[i].as_py(), rows.column("mean")[i].values.to_numpy(), rows.column("scatter")[i].values.to_numpy()
        )
        for i in range(rows.num_rows)
    }


def label_type(df: DataFrame, label: str) -> T.DataType:
    return df.schema[label].dataType


def score_rows(rows: DataFrame, models: Mapping[tuple[int, int], Sequence[tuple[str, str, LinearModel]]],
               keep: Sequence[str], label: str, classes: Sequence, features: str = "features",
               fold_array: str | None = None) -> DataFrame:
    """Predictions of linear models: one row per signal and model.

    ``models`` maps (repeat, fold) to (recipe, classifier, model); with
    ``fold_array`` a signal is scored, per repeat, by the models that did not see
    its fold, without it by the models under (0, 0).  The weights are a few
    vectors of signal length per model and travel with the task.
    """
    classes = list(classes)
    kept = [rows.schema[c] for c in keep]
    kind = label_type(rows, label)
    schema = T.StructType([
        T.StructField("recipe", T.StringType()), T.StructField("classifier", T.StringType()),
        T.StructField("repeat", T.LongType()), T.StructField("fold", T.LongType()), *kept,
        T.StructField("y_true", kind), T.StructField("y_pred", kind), T.StructField("scores", T.ArrayType(T.DoubleType())),
    ])
    taken = rows.select(*keep, F.col(label).alias("_y"), *([fold_array] if fold_array else []),
                        F.col(features).cast("array<double>").alias("_x"))
    n_keep, k = len(keep), len(classes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = features_matrix(batch.column(batch.num_columns - 1))
            if not np.isfinite(x).all():
                raise ValueError("signal is not finite")
            y = batch.column(n_keep)
            lookup = pa.array(classes, type=y.type)
            folds = features_matrix(batch.column(n_keep + 1)) if fold_array else np.zeros((len(x), 1), dtype=int)
            for r in range(folds.shape[1]):
                repeat = r + 1 if fold_array else 0
                for f in np.unique(folds[:, r]):
                    idx = np.flatnonzero(folds[:, r] == f)
                    sub, take = x[idx], pa.array(idx)
                    ids = [batch.column(i).take(take) for i in range(n_keep)]
                    true = y.take(take)
                    for recipe, classifier, model in models[(repeat, int(f))]:
                        best, prob = model.scores(sub, k)
                        m = len(idx)
                        cols = [pa.repeat(recipe, m), pa.repeat(classifier, m), pa.array(np.full(m, repeat)),
                                pa.array(np.full(m, int(f))), *ids, true, lookup.take(pa.array(best)), list_array(prob)]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return taken.mapInArrow(score, schema)


@dataclass(frozen=True)
class FittedLinear:
    """A linear classifier on raw signals, its recipe folded into the weights."""

    model: LinearModel
    classes: tuple
    recipe: str

    def predict(self, df: DataFrame, keep: Sequence[str], label: str, features: str = "features") -> DataFrame:
        models = {(0, 0): [(self.recipe, self.model.kind, self.model)]}
        return score_rows(df, models, keep, label, self.classes, features)

    def to_rows(self, spark) -> DataFrame:
        """Parameters as a table: one row per output with its weight vector."""
        rows = [(self.recipe, self.model.kind, i, [str(c) for c in self.classes], self.model.weights[:, i].tolist(),
                 float(self.model.intercept[i])) for i in range(self.model.weights.shape[1])]
        return spark.createDataFrame(
            rows, "recipe string, classifier string, output int, classes array<string>, weights array<double>, intercept double"
        )


@dataclass(frozen=True)
class FittedMllib:
    """A recipe with frozen parameters and an MLlib model behind it."""

    name: str
    recipe: object
    model: object

    def predict(self, df: DataFrame, keep: Sequence[str], label: str, features: str = "features") -> DataFrame:
        rows = self.recipe.transform(df.select(*keep, F.col(label).alias("y_true"), F.col(features).alias("features")))
        return self.model.predict(rows).select(
            F.lit(self.recipe.recipe.code).alias("recipe"), F.lit(self.name).alias("classifier"),
            F.lit(0).cast("long").alias("repeat"), F.lit(0).cast("long").alias("fold"), *keep, "y_true",
            F.col("y_pred").cast(label_type(df, label)).alias("y_pred"), "scores",
        )


def fit(classifier: str, recipe: str, train: DataFrame, label: str, classes: Sequence, config: Mapping | None = None,
        features: str = "features"):
    """Fit a classifier after a recipe on training rows.  Runs jobs."""
    check_name(classifier)
    conf = settings(config, classes)
    if classifier == "PLS-PM1" and len(classes) != 2:
        raise ValueError("PLS-PM1 takes two classes")
    if classifier in LINEAR:
        model = linear.fit_linear(classifier, Recipe(recipe), class_stats(train, label, classes, features), list(classes), conf)
        return FittedLinear(model, tuple(classes), recipe)
    fitted = recipe_fit(train, recipe, features)
    rows = fitted.transform(train.select(label, F.col(features).alias("features")))
    return FittedMllib(classifier, fitted, MLLIB[classifier](rows, label, classes, conf))
