"""Recipes: a fixed order of binning, smoothing, scaling and differencing, with parameters from training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.functions import arrays as A
from wavecohort.functions import batch
from wavecohort.operators.aggregates import points, to_array


@dataclass(frozen=True)
class Recipe:
    """A recipe id: digits for bin, smooth, scale and difference, one spare digit, then 'X'."""

    code: str

    def __post_init__(self) -> None:
        if len(self.code) != 6 or not self.code[:5].isdigit() or self.code[5] != "X":
            raise ValueError(f"a recipe id is five digits and an X, not {self.code!r}")

    @property
    def bin(self) -> int:
        return int(self.code[0])

    @property
    def smooth(self) -> int:
        return int(self.code[1])

    @property
    def scale(self) -> bool:
        return self.code[2] == "2"

    @property
    def difference(self) -> int:
        c = int(self.code[3])
        return c if c in (1, 2) else 0

    def smooth_window(self) -> tuple[int, int]:
        """(window, polynomial order)."""
        window = max(5, 2 * self.smooth + 1)
        return window, min(self.smooth, window - 1)

    def width(self, d: int) -> int:
        out = d // self.bin if self.bin > 1 else d
        if out < 1:
            raise ValueError("bin width exceeds the signal length")
        return out - self.difference

    def before_scale(self, x: np.ndarray) -> np.ndarray:
        """Binning and smoothing of a batch of signals."""
        if self.bin > 1:
            x = batch.bin_mean(x, self.bin)
        if self.smooth > 0:
            x = batch.smooth(x, *self.smooth_window())
        return x


def zscore_fit(df: DataFrame, keys: Sequence[str] = (), features: str = "features") -> DataFrame:
    """(keys, mu, sigma): mean and sample std per axis point as arrays; a zero std becomes 1.

    Partial sums per (key, point) combine map-side; the arrays have the axis length.
    """
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    per_point = points(df, keys, features).groupBy(*keys, "pos").agg(
        F.avg("value").alias("m"), std.alias("s")
    ).withColumn("s", F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s")))
    packed = to_array(per_point.withColumn("ms", F.struct("m", "s")), keys, "ms", "ms")
    return packed.select(
        *keys, F.transform("ms", lambda v: v["m"]).alias("mu"), F.transform("ms", lambda v: v["s"]).alias("sigma")
    )


def zscore_apply(df: DataFrame, params: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """Scale rows with frozen parameters.

    ``params`` has one row per key of the configuration grid and arrays of axis
    length; the planner decides how to join it.  Without keys it is one row.
    """
    if not keys:
        df, params, keys = df.withColumn("_k", F.lit(0)), F.broadcast(params.withColumn("_k", F.lit(0))), ["_k"]
    return df.join(params, list(keys)).withColumn(
        features, A.zscore_apply(F.col(features), F.col("mu"), F.col("sigma"))
    ).drop("mu", "sigma", "_k")


@dataclass(frozen=True)
class FittedRecipe:
    """A recipe with its frozen training parameters."""

    recipe: Recipe
    width_in: int
    mu: tuple[float, ...] = ()
    sigma: tuple[float, ...] = ()

    def kernel(self, x: np.ndarray) -> np.ndarray:
        y = self.recipe.before_scale(batch.require_finite(x, self.width_in))
        if self.recipe.scale:
            y = (y - np.asarray(self.mu)) / np.asarray(self.sigma)
        return np.diff(y, self.recipe.difference, axis=1)

    def apply(self, x: Column) -> Column:
        """All steps in one pass over an Arrow batch."""
        return batch.batch_column(x, self.kernel)

    def transform(self, df: DataFrame, features: str = "features", recipe: str | None = None) -> DataFrame:
        """Transform rows of any split or stream; ``recipe`` guards against mixing up parameters."""
        if recipe is not None and recipe != self.recipe.code:
            raise ValueError(f"parameters belong to {self.recipe.code}, not {recipe}")
        return df.withColumn(features, self.apply(F.col(features)))

    def to_row(self, spark: SparkSession) -> DataFrame:
        """The parameters as a one-row table."""
        schema = T.StructType([
            T.StructField("recipe", T.StringType()), T.StructField("width_in", T.LongType()),
            T.StructField("mu", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.ArrayType(T.DoubleType())),
        ])
        return spark.createDataFrame([(self.recipe.code, self.width_in, list(self.mu), list(self.sigma))], schema)

    @staticmethod
    def from_row(df: DataFrame) -> "FittedRecipe":
        row = df.head()
        return FittedRecipe(Recipe(row["recipe"]), row["width_in"], tuple(row["mu"]), tuple(row["sigma"]))


def signal_width(signals: DataFrame, features: str = "features") -> int:
    """Common length of all signals."""
    sizes = signals.agg(F.min(F.size(features)).alias("low"), F.max(F.size(features)).alias("high")).head()
    if sizes["low"] is None:
        raise ValueError("no training signals")
    if sizes["low"] != sizes["high"]:
        raise ValueError("training signals differ in length")
    return sizes["low"]


def recipe_fit(train: DataFrame, code: str, features: str = "features") -> FittedRecipe:
    """Learn a recipe's parameters from training rows.  Runs one aggregation; its result has the axis length."""
    recipe = Recipe(code)
    if not recipe.scale:
        return FittedRecipe(recipe, signal_width(train, features))
    ready = batch.batch_column(F.col(features), lambda x: recipe.before_scale(batch.require_finite(x)))
    row = zscore_fit(train.select(F.size(features).alias("w"), ready.alias("features")), ["w"]).head(2)
    if not row:
        raise ValueError("no training signals")
    if len(row) != 1:
        raise ValueError("training signals differ in length")
    return FittedRecipe(recipe, row[0]["w"], tuple(row[0]["mu"]), tuple(row[0]["sigma"]))


def recipe_fit_transform(train: DataFrame, code: str, features: str = "features") -> tuple[DataFrame, FittedRecipe]:
    fitted = recipe_fit(train, code, features)
    return fitted.transform(train, features), fitted


def recipe_dims(df: DataFrame, codes: Sequence[str], keys: Sequence[str], features: str = "features") -> DataFrame:
    """Width before and after each step of the recipes, per signal."""
    rows = []
    d = F.size(features).cast("long")
    for code in codes:
        r = Recipe(code)
        binned = F.floor(d / r.bin) if r.bin > 1 else d
        steps = [("bin", d, binned), ("smooth", binned, binned), ("scale", binned, binned),
                 ("difference", binned, binned - r.difference)]
        rows += [
            F.struct(F.lit(code).alias("recipe"), F.lit(i + 1).cast("long").alias("step_no"), F.lit(name).alias("step"),
                     before.cast("long").alias("width_before"), after.cast("long").alias("width_after"))
            for i, (name, before, after) in enumerate(steps)
        ]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


# --- presets --------------------------------------------------------------------


def norm_type(x: Column, kind: str = "L2") -> Column:
    """'L2' or 'None'; 'SNV' and 'MinMax' are accepted and mean L2."""
    if kind == "None":
        return x
    if kind in ("L2", "SNV", "MinMax"):
        return A.l2_normalize(x)
    raise ValueError(f"unknown normalisation: {kind}")


@dataclass(frozen=True)
class Preset:
    """Row-local processing: bin, smooth, normalise, differentiate; None leaves a step out."""

    bin: int = 1
    smooth: tuple[int, int] | None = None
    norm: str = "L2"
    derivative: tuple[int, int, int] | None = (5, 2, 2)

    def __post_init__(self) -> None:
        if self.bin < 1:
            raise ValueError("bin width must be at least 1")
        if self.smooth is not None:
            A.check_window(*self.smooth)
        if self.derivative is not None:
            A.check_window(*self.derivative)
        if self.norm not in ("L2", "None", "SNV", "MinMax"):
            raise ValueError(f"unknown normalisation: {self.norm}")

    def kernel(self, x: np.ndarray) -> np.ndarray:
        if self.bin > 1:
            x = batch.bin_mean(x, self.bin, omit_nan=True)
        if self.smooth is not None:
            x = batch.smooth(x, *self.smooth)
        if self.norm != "None":
            x = batch.unit(x)
        return x if self.derivative is None else batch.derivative(x, *self.derivative)

    def apply(self, x: Column) -> Column:
        """All steps in one pass over an Arrow batch."""
        return batch.batch_column(x, self.kernel)


PP1 = Preset()
PP2 = Preset(bin=4, smooth=(11, 2))


def l2_then_zscore(train: DataFrame, rows: DataFrame, features: str = "features") -> DataFrame:
    """Unit-length rows, then scaling with the mean and std of the unit-length training rows."""
    unit = lambda df: df.withColumn(features, A.l2_normalize(F.col(features)))
    return zscore_apply(unit(rows), zscore_fit(unit(train), features=features), [], features)
