"""Ranks and running totals inside groups of any size.

A window over a group puts the whole group into one task.  Here the order is cut
into buckets first (hash prefixes or value quantiles), the window runs inside
(group, bucket), and each bucket gets the total of the buckets before it from a
small table.  A group holding a third of all rows is thus spread over as many
tasks as there are buckets, and the result is still exact.

NULL is a group key like any other, and rows without a value to order by come in the first bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavecohort.functions.arrays import doubles
from wavecohort.operators.sets import join_null_safe

HASH_PREFIX = 3  # hex digits: 4096 buckets
BUCKETS = 1024  # a power of two


def with_value_bucket(df: DataFrame, col: str, out: str, weight: Column | None = None) -> DataFrame:
    """Add an order-preserving bucket number that spreads the rows evenly.

    The cut points are approximate quantiles of the column over all rows, one
    array of fixed length, so the broadcast is bounded.  A bucket is the number
    of cut points not above the value, found by bisection in generated code.
    NaN falls into the last bucket, as it sorts last in Spark.  ``weight`` must
    be positive on every row; naming the other aggregated columns in it lets
    both uses of ``df`` share one shuffle.
    """
    value = F.col(col).cast("double")
    seen = value if weight is None else F.when(weight > 0, value)
    shares = doubles([i / BUCKETS for i in range(1, BUCKETS)])
    cuts = df.agg(F.percentile_approx(seen, shares, 4 * BUCKETS).alias("_cuts")).withColumn("_k", F.lit(0))
    steps, at, step = [], "0", BUCKETS // 2
    while step:
        steps.append(f"{at} + IF(get(_cuts, {at} + {step - 1}) <= _v, {step}, 0) AS _b{step}")
        at, step = f"_b{step}", step // 2
    joined = df.select("*", F.lit(0).alias("_k"), value.alias("_v")).join(F.broadcast(cuts), "_k")
    return joined.selectExpr(*df.columns, "_v", "_cuts", *steps).select(*df.columns, F.col(at).alias(out))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    inclusive: bool = True,
    totals: bool = False,
) -> DataFrame:
    """Running sums over ``order`` within ``keys``, exact across buckets.

    ``bucket`` must not contradict ``order``.  With ``totals`` each sum also gets
    a ``<name>_total`` column holding the sum over the whole group.
    """
    keys = list(keys)
    if not keys:
        df = df.withColumn("_all", F.lit(0))
        keys = ["_all"]
    inputs = {name: f"_in_{name}" for name in sums}
    df = df.withColumns({inputs[name]: value for name, value in sums.items()})
    end = 0 if inclusive else -1
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    per_bucket = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(c) for c in inputs.values()])
    offsets = per_bucket.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{n}") for n, c in inputs.items()],
        *([F.sum(c).over(whole).alias(f"{n}_total") for n, c in inputs.items()] if totals else []),
    )
    local = df.withColumns(
        {name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in inputs.items()}
    )
    joined = join_null_safe(local, offsets, [*keys, bucket])
    return joined.withColumns({name: F.col(name) + F.col(f"_off_{name}") for name in sums}).drop(
        bucket, "_all", *inputs.values(), *[f"_off_{name}" for name in sums]
    )


def hash_rank(
    df: DataFrame, keys: Sequence[str], text: Column, tie: Sequence[str], out: str = "rn", totals: bool = False
) -> DataFrame:
    """1-based rank in md5 order of ``text``, ties broken by the ``tie`` columns.

    md5 spreads evenly and its hexadecimal prefix keeps its order, so the prefix is the bucket.
    """
    hashed = df.withColumn("_h", F.md5(text.cast("string"))).withColumn("_hb", F.substring("_h", 1, HASH_PREFIX))
    order = [F.col("_h"), *[F.col(t) for t in tie]]
    return running_sum(hashed, keys, "_hb", order, {out: F.lit(1).cast("long")}, totals=totals).drop("_h")


def row_rank(
    df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (), out: str = "rn", totals: bool = False
) -> DataFrame:
    """1-based row number by a numeric column."""
    bucketed = with_value_bucket(df, order, "_vb")
    by = [F.col(order), *[F.col(t) for t in tie]]
    return running_sum(bucketed, keys, "_vb", by, {out: F.lit(1).cast("long")}, totals=totals)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with their count, the rows below them and the group's size.

    Equal values collapse before the window, so ties cost nothing.
    Columns: keys, value, ``cnt``, ``below``, ``n``.
    """
    cells = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    cells = with_value_bucket(cells, value, "_vb", weight=F.col("cnt"))
    ranked = running_sum(cells, keys, "_vb", [F.col(value)], {"below": F.col("cnt")}, inclusive=False, totals=True)
    return ranked.withColumnRenamed("below_total", "n")


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group; a NaN in the group makes it NaN."""
    ranked = value_ranks(df, keys, value)
    low = F.floor((F.col("n") + 1) / 2)
    high = F.floor((F.col("n") + 2) / 2)

    def at(k: Column) -> Column:
        return F.sum(F.when((F.col("below") < k) & (k <= F.col("below") + F.col("cnt")), F.col(value)))

    middle = (at(low) + at(high)) / 2
    return ranked.groupBy(*keys).agg(
        F.when(F.max(F.isnan(value)), F.lit(float("nan"))).otherwise(middle).alias(out)
    )


def tie_average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their tie-averaged rank: rows below plus half of (ties + 1)."""
    return value_ranks(df, keys, value).withColumn(
        "avg_rank", F.col("below") + (F.col("cnt") + 1).cast("double") / 2
    )
