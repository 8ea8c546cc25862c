"""Leakage-safe splitting: folds over groups, guards, sampling.

The order inside a class is that of ``md5(seed:id)``, the same in every engine
and on every run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavecohort.operators.aggregates import majority_label
from wavecohort.operators.ordered import hash_rank, row_rank, running_sum


def seeded(seed: Column | int, ident: str) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.concat_ws(":", s.cast("string"), F.col(ident).cast("string"))


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(repeat, fold, group, label): every group in exactly one fold per repeat, balanced within each class."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    groups = majority_label(df, [group], label, out=label)
    rows = groups.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)).cast("array<bigint>")))
    ranked = hash_rank(rows, ["repeat", label], seeded(F.lit(seed - 1) + F.col("repeat"), group), [group])
    return ranked.select("repeat", ((F.col("rn") - 1) % k + 1).alias("fold"), group, label)


def fold_arrays(folds: DataFrame, group: str, repeats: int) -> DataFrame:
    """One row per group with its fold in each repeat, so that signals are joined once and not once per repeat."""
    return folds.groupBy(group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"].cast("int")
        ).alias("folds")
    )


def folds_remainder_last(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Contiguous chunks of floor(n / K) groups per class, the remainder in the last fold."""
    groups = majority_label(df, [group], label, out=label)
    ranked = hash_rank(groups, [label], seeded(seed, group), [group], totals=True)
    size = F.floor(F.col("rn_total") / k)
    chunk = F.least(F.floor((F.col("rn") - 1) / F.greatest(size, F.lit(1))), F.lit(k - 1)) + 1
    return ranked.select(
        F.when(size > 0, chunk).otherwise(F.lit(k)).cast("long").alias("fold"), group, label
    )


def folds_missing_class(folds: DataFrame, label: str, classes: Sequence, k: int) -> DataFrame:
    """(fold, label) pairs whose training side lacks the class; empty for usable folds."""
    spark = folds.sparkSession
    grid = spark.range(1, k + 1).select(
        F.col("id").alias("fold"), F.explode(F.array(*[F.lit(c) for c in classes])).alias(label)
    )
    per_fold = folds.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n_test"))
    per_class = per_fold.groupBy(label).agg(F.sum("n_test").alias("n_all"))
    joined = grid.join(per_fold, ["fold", label], "left").join(per_class, label, "left")
    left = F.coalesce(F.col("n_all"), F.lit(0)) - F.coalesce(F.col("n_test"), F.lit(0))
    return joined.where(left == 0).select("fold", label)


def semi_group(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    return df.join(groups.select(group), group, "left_semi")


def anti_train(df: DataFrame, test_groups: DataFrame, group: str) -> DataFrame:
    return df.join(test_groups.select(group), group, "left_anti")


def leaked_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    return train.select(group).intersect(test.select(group))


def leakage_guard(train: DataFrame, test: DataFrame, group: str) -> None:
    """Raise when a group is on both sides.  Runs a job that stops at the first hit."""
    hit = leaked_groups(train, test, group).limit(1).collect()
    if hit:
        raise ValueError(f"group {hit[0][0]!r} is in both train and test")


def fold_sizes(df: DataFrame, folds: DataFrame, group: str, k: int) -> DataFrame:
    """Rows and groups on each side of every (repeat, fold).

    One pass: rows are counted per group, then per fold; the training side is total minus test.
    """
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    test = folds.join(per_group, group).groupBy("repeat", "fold").agg(
        F.sum("n").alias("n_test"), F.count(F.lit(1)).alias("n_test_groups")
    )
    whole = W.partitionBy("repeat")
    return test.select(
        "repeat", "fold", (F.sum("n_test").over(whole) - F.col("n_test")).alias("n_train"), "n_test",
        (F.sum("n_test_groups").over(whole) - F.col("n_test_groups")).alias("n_train_groups"), "n_test_groups",
    )


def sample_by_hash(df: DataFrame, keys: Sequence[str], ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per key chosen in hash order (a sampling operator)."""
    return hash_rank(df, keys, seeded(seed, ident), [ident]).where(F.col("rn") <= n)


def split_first_share(df: DataFrame, label: str, order: str, share: float = 0.7) -> DataFrame:
    """First round(share * n) rows of each class to train, the rest to test; ``order`` is a unique number."""
    ranked = row_rank(df, [label], order, totals=True)
    return ranked.withColumn(
        "split", F.when(F.col("rn") <= F.round(F.col("rn_total") * share), F.lit("train")).otherwise(F.lit("test"))
    ).drop("rn", "rn_total")


def balanced_group_split(df: DataFrame, group: str, label: str, cluster: str, forced: Mapping[str, str],
                         train_share: float = 0.7, seed: int = 42) -> DataFrame:
    """Whole groups to train or test.

    A group with several labels counts, with all its rows, for the most frequent
    one, the smallest on ties.  A group whose cluster is in ``forced`` goes where the map says.  The others
    fill the training side of their class, in hash order, until it holds the
    class's target: ``train_share`` of the smallest class, the same for every class.
    """
    by_label = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(cluster).alias(cluster))
    per_group = by_label.groupBy(group).agg(
        F.min_by(label, F.struct(-F.col("n"), label)).alias(label), F.sum("n").alias("n"), F.min(cluster).alias(cluster)
    )
    table = F.create_map(*[F.lit(v) for pair in forced.items() for v in pair])
    placed = per_group.withColumn("forced", F.try_element_at(table, F.col(cluster)))
    per_class = placed.groupBy(label).agg(
        F.sum("n").alias("class_n"),
        F.sum(F.when(F.col("forced") == "train", F.col("n")).otherwise(F.lit(0))).alias("already"),
    )
    # one row per class
    target = per_class.withColumn(
        "target", F.floor(F.min("class_n").over(W.partitionBy(F.lit(0))) * train_share)
    ).select(label, "target", "already")
    hashed = placed.where(F.col("forced").isNull()).withColumn("_h", F.md5(seeded(seed, group))).withColumn(
        "_hb", F.substring("_h", 1, 3)
    )
    filled = running_sum(hashed, [label], "_hb", [F.col("_h"), F.col(group)], {"upto": F.col("n")})
    chosen = filled.join(target, label).withColumn(
        "split", F.when(F.col("upto") + F.col("already") <= F.col("target"), F.lit("train")).otherwise(F.lit("test"))
    )
    cols = [group, label, "n", "split"]
    fixed = placed.where(F.col("forced").isNotNull()).withColumn("split", F.col("forced"))
    return chosen.select(*cols).unionByName(fixed.select(*cols))
