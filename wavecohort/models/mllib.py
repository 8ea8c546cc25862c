"""Classifiers fitted by MLlib: random-feature SVM, random forest, logistic regression.

Each fitted model predicts on a DataFrame and adds ``y_pred`` and ``scores``
(one probability per declared class).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecohort.functions import arrays as A
from wavecohort.functions.labels import index_label, label_index
from wavecohort.functions.batch import batch_column


def labelled(df: DataFrame, label: str, features: str, classes: Sequence, weight: Column | None = None) -> DataFrame:
    """(x, y, w) rows for a fit; y is the 0-based class number in declared order."""
    w = F.lit(1.0) if weight is None else weight
    return df.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("x"),
        (label_index(F.col(label), classes) - 1).cast("double").alias("y"), w.cast("double").alias("w"),
    )


def class_weight(label: str, positive, cost: float) -> Column:
    """``cost`` for the positive class, 1 for the rest."""
    return F.when(F.col(label) == F.lit(positive), F.lit(float(cost))).otherwise(F.lit(1.0))


def with_class(df: DataFrame, index: Column, classes: Sequence, scores: Column) -> DataFrame:
    return df.withColumns({"scores": scores, "y_pred": index_label(index, classes)})


@dataclass(frozen=True)
class RandomFeatures:
    """Random Fourier features (Rahimi and Recht 2007) of the kernel exp(-|a - b|^2 / scale^2)."""

    omega: np.ndarray
    phase: np.ndarray

    @staticmethod
    def draw(d: int, scale: float, n: int, seed: int) -> "RandomFeatures":
        rng = np.random.default_rng(seed)
        return RandomFeatures(rng.normal(0.0, np.sqrt(2.0) / scale, (d, n)), rng.uniform(0.0, 2 * np.pi, n))

    def column(self, features: str) -> Column:
        omega, phase = self.omega, self.phase
        factor = np.sqrt(2.0 / len(phase))

        return batch_column(F.col(features), lambda m: factor * np.cos(m @ omega + phase))


def auto_scale(df: DataFrame, features: str = "features") -> float:
    """Root of the mean squared distance between two rows, that is of twice the summed variances."""
    vec = array_to_vector(F.col(features).cast("array<double>"))
    row = df.agg(Summarizer.variance(vec).alias("v")).head()
    total = float(np.sum(row["v"].toArray()))
    return float(np.sqrt(2.0 * total)) if total > 0 else 1.0


@dataclass(frozen=True)
class SvmModel:
    features_map: RandomFeatures
    model: object
    classes: tuple
    platt: object = None

    def decision(self, df: DataFrame, features: str = "features") -> DataFrame:
        mapped = df.withColumn("_z", array_to_vector(self.features_map.column(features)))
        scored = self.model.transform(mapped)
        return scored.withColumn("decision", vector_to_array("_raw")[1]).drop("_z", "_raw", "_hit")

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Label by the sign of the decision value; scores by softmax of (-f, f), or the fitted posterior."""
        scored = self.decision(df, features)
        index = F.when(F.col("decision") >= 0, F.lit(2)).otherwise(F.lit(1))
        if self.platt is not None:
            posterior = self.platt.transform(scored.withColumn("_f", array_to_vector(F.array("decision"))))
            out = with_class(posterior, index, self.classes, vector_to_array("_post"))
            return out.drop("decision", "_f", "_post", "_lraw", "_lhit")
        scores = A.softmax_scores(F.array(-F.col("decision"), F.col("decision")))
        return with_class(scored, index, self.classes, scores).drop("decision")


def svm_fit(train: DataFrame, label: str, classes: Sequence, config: Mapping, features: str = "features") -> SvmModel:
    """RBF support vector machine through random features and a linear one.

    An approximation of the kernel machine, linear in the number of rows.
    ``cost_penalty`` weights the positive class; ``svm_platt`` adds a posterior fit.
    """
    if len(classes) != 2:
        raise ValueError("the support vector machine takes two classes")
    scale = config["svm_kernel_scale"]
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("d")).head()
    scale = auto_scale(train, features) if scale == "auto" else float(scale)
    maps = RandomFeatures.draw(shape["d"], scale, config["svm_features"], config["seed"])
    mapped = train.withColumn("_z", maps.column(features))
    weight = class_weight(label, config["positive"], config["cost_penalty"]) if config.get("cost_penalty") else None
    rows = labelled(mapped, label, "_z", classes, weight)
    svc = LinearSVC(featuresCol="x", labelCol="y", weightCol="w", standardization=False,
                    regParam=1.0 / (config["svm_C"] * shape["n"]), maxIter=config["max_iter"], rawPredictionCol="_raw",
                    predictionCol="_hit")
    model = svc.fit(rows).setFeaturesCol("_z")
    fitted = SvmModel(maps, model, tuple(classes))
    if not config.get("svm_platt"):
        return fitted
    scored = labelled(fitted.decision(train, features).withColumn("_f", F.array("decision")), label, "_f", classes)
    platt = LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="_post", rawPredictionCol="_lraw",
                               predictionCol="_lhit", standardization=False, maxIter=config["max_iter"]).fit(scored)
    return SvmModel(maps, model, tuple(classes), platt.setFeaturesCol("_f"))


@dataclass(frozen=True)
class ProbabilityModel:
    """An MLlib classifier whose probability vector follows the declared class order."""

    model: object
    classes: tuple

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        mapped = df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
        scored = self.model.transform(mapped)
        out = with_class(scored, F.col("_hit") + 1, self.classes, vector_to_array("_prob"))
        return out.drop("_x", "_prob", "_raw", "_hit")


_OUT = {"featuresCol": "x", "labelCol": "y", "weightCol": "w", "probabilityCol": "_prob", "rawPredictionCol": "_raw",
        "predictionCol": "_hit"}


def forest_fit(train: DataFrame, label: str, classes: Sequence, config: Mapping, features: str = "features") -> ProbabilityModel:
    """Bagged trees with sqrt(d) candidate features per split; ``cost_penalty`` weights the positive class."""
    weight = class_weight(label, config["positive"], config["cost_penalty"]) if config.get("cost_penalty") else None
    forest = RandomForestClassifier(
        **_OUT, numTrees=config["rf_ntrees"], minInstancesPerNode=config["rf_min_leaf_size"],
        maxDepth=config["rf_max_depth"], featureSubsetStrategy="sqrt", seed=config["seed"],
    )
    return ProbabilityModel(forest.fit(labelled(train, label, features, classes, weight)).setFeaturesCol("_x"), tuple(classes))


def logistic_fit(train: DataFrame, label: str, classes: Sequence, config: Mapping, features: str = "features") -> ProbabilityModel:
    reg = LogisticRegression(**_OUT, maxIter=config["max_iter"], regParam=config.get("lr_reg", 0.0), standardization=False)
    return ProbabilityModel(reg.fit(labelled(train, label, features, classes)).setFeaturesCol("_x"), tuple(classes))
