"""Set operations on group ids and split checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_groups(df: DataFrame, group: str) -> DataFrame:
    return df.select(group).distinct()


def intersect_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    return a.select(group).intersect(b.select(group))


def union_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    return a.select(group).union(b.select(group)).distinct()


def outside_groups(part: DataFrame, complete: DataFrame, group: str) -> DataFrame:
    """Ids of ``part`` that the complete set lacks; empty when it is a subset."""
    return part.select(group).distinct().join(complete.select(group).distinct(), group, "left_anti")


def subset_check(part: DataFrame, complete: DataFrame, group: str) -> DataFrame:
    return outside_groups(part, complete, group).agg(
        F.count(F.lit(1)).alias("n_outside"), (F.count(F.lit(1)) == 0).alias("is_subset")
    )


def split_counts(df: DataFrame, split: str, group: str) -> DataFrame:
    """Group and row counts of both splits as one row."""
    tr, te = F.col(split) == "train", F.col(split) == "test"
    return df.agg(
        F.countDistinct(F.when(tr, F.col(group))).alias("train_groups"),
        F.countDistinct(F.when(te, F.col(group))).alias("test_groups"),
        F.sum(tr.cast("long")).alias("train_count"),
        F.sum(te.cast("long")).alias("test_count"),
    )


def split_count_check(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare two one-row tables with the columns of :func:`split_counts`."""
    names = ["train_groups", "test_groups", "train_count", "test_count"]
    a = actual.select(F.lit(0).alias("_k"), *names)
    e = expected.select(F.lit(0).alias("_k"), *[F.col(n).alias(f"expected_{n}") for n in names])
    return a.join(e, "_k").select(
        *names, *[(F.col(n) == F.col(f"expected_{n}")).alias(f"{n}_ok") for n in names]
    )


def except_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Column names of ``left`` that ``right`` lacks, in order."""
    other = set(right.columns)
    return [c for c in left.columns if c not in other]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` stay once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
