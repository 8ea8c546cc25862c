"""Reading sample tables and finding their columns."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.functions import arrays as A
from wavecohort.operators.cleaning import nan_policy
from wavecohort.operators.folds import leakage_guard

# Accepted column names, the preferred one first.
SPECTRA_COLUMNS = ("RawSpectra", "MeanRawSpectrum", "CombinedRawSpectra")
LABEL_COLUMNS = ("WHO_Grade", "label")
GROUP_COLUMNS = ("Patient_ID", "patient")
# Columns of earlier table layouts.
STALE_COLUMNS = ("CombinedSpectra_PP1", "CombinedSpectra_PP2", "MeanSpectrum_PP1", "MeanSpectrum_PP2", "CombinedRawSpectra")


def first_present(df: DataFrame, names: Sequence[str], what: str) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column; expected one of {', '.join(names)}")


def resolve_columns(df: DataFrame, spectra: str = "auto", rename: bool = True) -> DataFrame:
    """Select (spectra, label, group) by name priority, next to every other column."""
    x = first_present(df, SPECTRA_COLUMNS, "spectra") if spectra == "auto" else spectra
    if x not in df.columns:
        raise ValueError(f"no spectra column {x!r}")
    if x == SPECTRA_COLUMNS[-1]:
        warnings.warn(f"{x} is an old column name", DeprecationWarning, stacklevel=2)
    y = first_present(df, LABEL_COLUMNS, "label")
    g = first_present(df, GROUP_COLUMNS, "group")
    chosen = {x: "spectra", y: "label", g: "group_id"}
    rest = [c for c in df.columns if c not in chosen]
    return df.select(*rest, *[F.col(c).alias(n) for c, n in chosen.items()])


def guard_columns(df: DataFrame) -> None:
    """Reject a table without spectra or with columns of an earlier layout.  Looks at the schema only."""
    if not set(SPECTRA_COLUMNS[:2]) & set(df.columns):
        raise ValueError(f"table needs one of {', '.join(SPECTRA_COLUMNS[:2])}")
    stale = [c for c in STALE_COLUMNS if c in df.columns]
    if stale:
        raise ValueError(f"table holds columns of an earlier layout: {', '.join(stale)}")


def load_samples(df: DataFrame, spectra: str = "auto", method: str = "mean", policy: str = "error") -> DataFrame:
    """One feature vector per sample row: mean or median of its signals, NaN handled by ``policy``."""
    rows = resolve_columns(df, spectra)
    kind = rows.schema["spectra"].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    if method not in ("mean", "median"):
        raise ValueError(f"unknown aggregation: {method}")
    x = F.col("spectra").cast("array<array<double>>" if nested else "array<double>")
    if nested:
        x = A.matrix_mean(x) if method == "mean" else A.matrix_median(x)
    return nan_policy(rows.withColumn("features", x).drop("spectra"), policy)


def scan_samples(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_samples(spark.read.parquet(path), **options)


def load_split(train: DataFrame, test: DataFrame, group: str = "group_id", guard: bool = True) -> DataFrame:
    """Both splits as one table with a ``split`` column.  The guard runs a job and raises on shared groups."""
    if guard:
        leakage_guard(train, test, group)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def scan_split(spark: SparkSession, folder: str, group: str = "group_id") -> DataFrame:
    return load_split(spark.read.parquet(f"{folder}/train"), spark.read.parquet(f"{folder}/test"), group)


def scan_csv_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header.  Give a schema for anything large; without one Spark reads the file twice."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def column_profile(df: DataFrame) -> DataFrame:
    """The fields of a table: position, name and type; rows, nulls and distinct values; smallest and largest value.

    ``least`` and ``most`` compare values as text and are NULL for floating
    types; ``least_number`` and ``most_number`` are NULL for types other than numbers.
    """
    def field(k: int, name: str, kind: str):
        c = F.col(f"`{name}`")
        floating = kind in ("float", "double")
        number = floating or kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")
        text = F.lit(None).cast("string") if floating else c.cast("string")
        value = c.cast("double") if number else F.lit(None).cast("double")
        return F.struct(
            F.lit(k).cast("long").alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("type"),
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(c.isNull(), 1)).alias("n_null"), F.count_distinct(c).alias("n_distinct"),
            F.min(text).alias("least"), F.max(text).alias("most"), F.min(value).alias("least_number"), F.max(value).alias("most_number"),
        )

    stats = [field(k, name, kind) for k, (name, kind) in enumerate(df.dtypes, 1)]
    return df.agg(F.array(*stats).alias("p")).select(F.explode("p").alias("p")).select("p.*")
