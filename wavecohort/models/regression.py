"""Partial least squares with several responses, and its projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions import arrays as A
from wavecohort.models import linear
from wavecohort.models.linear import Pls
from wavecohort.operators.outliers import pca, project, total_stats
from wavecohort.plans.recipes import signal_width


@dataclass(frozen=True)
class FittedPls:
    """Coefficients and loadings with the means they refer to."""

    pls: Pls
    x_mean: np.ndarray
    y_mean: np.ndarray

    def predict(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        """(keep, fitted array): mean of Y plus (x - mean) . beta."""
        p = project(df, keep, self.x_mean, self.pls.beta, features)
        means = A.doubles(self.y_mean)
        return p.select(*keep, F.zip_with("pc", means, lambda a, m: a + m).alias("fitted"))

    def x_scores(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        """T: one row projection per signal."""
        return project(df, keep, self.x_mean, self.pls.weights, features).withColumnRenamed("pc", "t")

    def y_scores(self, df: DataFrame, keep: Sequence[str], responses: str = "responses") -> DataFrame:
        """U: projection of the responses on their loadings."""
        return project(df, keep, self.y_mean, self.pls.y_loadings, responses).withColumnRenamed("pc", "u")


def pls_regress(df: DataFrame, components: int, features: str = "features", responses: str | None = "responses"):
    """PLS of array ``responses`` on array ``features``; without responses, the PCA of the features.

    One pass: the cross-products of X with Y are part of the moments of the concatenated array.
    """
    if responses is None:
        return pca(df, 1.1, components, features)
    d = signal_width(df, features)
    both = df.select(F.concat(F.col(features).cast("array<double>"), F.col(responses).cast("array<double>")).alias("_xy"))
    s = total_stats(both, "_xy")
    fit = linear.pls_fit(s.scatter[:d, :d], s.scatter[:d, d:], min(components, d, s.n - 1))
    return FittedPls(fit, s.mean[:d], s.mean[d:])


def lda_weighted_priors(df: DataFrame, keys: Sequence[str], label: str, low, high, cost: float) -> DataFrame:
    """Class shares with the high class counted ``cost`` times."""
    n1 = F.sum((F.col(label) == low).cast("double"))
    n3 = F.sum((F.col(label) == high).cast("double"))
    total = n1 + F.lit(float(cost)) * n3
    return df.groupBy(*keys).agg(
        F.try_divide(n1, total).alias("prior_low"), F.try_divide(F.lit(float(cost)) * n3, total).alias("prior_high")
    )
