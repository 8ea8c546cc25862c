"""Fitted models on disk: one folder a model, read back to a model that predicts the same.

A folder holds its parameters as tables (linear weights, recipe, random features) or in
the writers of MLlib (trees, linear machines, posteriors), and a manifest that names
its kind, recipe and classes.  The manifest is written last, so a folder
without one is an unfinished write and is not read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession

from wavecohort.models.classifiers import FittedLinear, FittedMllib
from wavecohort.models.linear import LinearModel
from wavecohort.models.mllib import ProbabilityModel, RandomFeatures, SvmModel
from wavecohort.plans.recipes import FittedRecipe

READERS = {"RandomForest": RandomForestClassificationModel, "Logistic": LogisticRegressionModel}
MANIFEST = "classifier string, recipe string, classes string, posterior boolean"


def _write(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.parquet(path, mode="errorifexists")


def save_model(spark: SparkSession, model: FittedLinear | FittedMllib, path: str) -> None:
    """Write a fitted model to a new folder.  Runs jobs; their size is that of the model."""
    if isinstance(model, FittedLinear):
        _write(model.to_rows(spark), f"{path}/weights")
        name, recipe, classes, posterior = model.model.kind, model.recipe, model.classes, False
    else:
        inner = model.model
        name, recipe, classes = model.name, model.recipe.recipe.code, inner.classes
        posterior = getattr(inner, "platt", None) is not None
        _write(model.recipe.to_row(spark), f"{path}/recipe")
        inner.model.save(f"{path}/model")
        if isinstance(inner, SvmModel):
            maps = inner.features_map
            rows = [(j, maps.omega[:, j].tolist(), float(maps.phase[j])) for j in range(len(maps.phase))]
            _write(spark.createDataFrame(rows, "feature int, omega array<double>, phase double"), f"{path}/features")
        if posterior:
            inner.platt.save(f"{path}/posterior")
    _write(spark.createDataFrame([(name, recipe, json.dumps(list(classes)), posterior)], MANIFEST), f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> FittedLinear | FittedMllib:
    """A model written by ``save_model``."""
    about = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").head()
    classes = tuple(json.loads(about["classes"]))
    name = about["classifier"]
    if name not in READERS and name != "SVM-RBF":
        rows = spark.read.parquet(f"{path}/weights").orderBy("output").collect()
        weights = np.array([r["weights"] for r in rows], dtype=float).T
        return FittedLinear(LinearModel(name, weights, np.array([r["intercept"] for r in rows])), classes, about["recipe"])
    recipe = FittedRecipe.from_row(spark.read.parquet(f"{path}/recipe"))
    if name != "SVM-RBF":
        return FittedMllib(name, recipe, ProbabilityModel(READERS[name].load(f"{path}/model"), classes))
    rows = spark.read.parquet(f"{path}/features").orderBy("feature").collect()
    maps = RandomFeatures(np.array([r["omega"] for r in rows], dtype=float).T, np.array([r["phase"] for r in rows]))
    platt = LogisticRegressionModel.load(f"{path}/posterior") if about["posterior"] else None
    return FittedMllib(name, recipe, SvmModel(maps, LinearSVCModel.load(f"{path}/model"), classes, platt))
