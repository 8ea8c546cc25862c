"""Order statistics of every axis point per key, on whole signals.

A key's signals are shuffled to one task as arrays and ordered there as a matrix,
so that a point costs eight bytes in the shuffle and not a row.  Keys of more than
``GATHER`` rows, found by a count that reads no signal, are never in one task:
they go point by point through the bucketed ranks of ``ordered``, with the same results.

NULL is a key like any other.  A missing value inside a signal counts as NaN, a
missing signal is left out, and a point is made of the signals that reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.functions.batch import features_matrix

# A task holds one key at a time: at most so many rows, of 8 bytes a point.
GATHER = 4096

# Rows x points in, one value a point out; masked values become NULL.
Statistic = Callable[[np.ndarray], np.ma.MaskedArray]
Points = Callable[[DataFrame], DataFrame]


def median(x: np.ndarray) -> np.ma.MaskedArray:
    """NaN propagates."""
    with np.errstate(invalid="ignore"):
        return np.ma.array(np.median(x, axis=0))


def mean_or_median(x: np.ndarray) -> np.ma.MaskedArray:
    """The mean, or the median of the finite values where the mean is not finite."""
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.ma.array(x.mean(axis=0))
    for j in np.flatnonzero(~np.isfinite(out.data)):
        finite = x[np.isfinite(x[:, j]), j]
        out[j] = np.median(finite) if len(finite) else np.ma.masked
    return out


def trimmed_mean(trim: float) -> Statistic:
    """Mean of the values whose percent rank lies in [trim, 1 - trim]; equal values share a rank, NaN ranks last."""

    def run(x: np.ndarray) -> np.ma.MaskedArray:
        n = len(x)
        if n == 1:
            return np.ma.array(x[0])
        s = np.sort(x, axis=0)
        fresh = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
        first = np.vstack([np.zeros((1, s.shape[1]), dtype=np.int64), np.where(fresh, np.arange(1, n)[:, None], 0)])
        share = np.maximum.accumulate(first, axis=0) / (n - 1)
        kept = (share >= trim) & (share <= 1 - trim)
        count = kept.sum(axis=0)
        with np.errstate(invalid="ignore"):
            total = np.where(kept, s, 0.0).sum(axis=0)
        return np.ma.array(total / np.maximum(count, 1), mask=count == 0)

    return run


def point_values(signals: pa.Array, statistic: Statistic) -> np.ma.MaskedArray:
    """The statistic at each point of one key's signals."""
    lengths = signals.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.unique(lengths)
    if len(ends) == 1:
        return statistic(features_matrix(signals)) if ends[0] else np.ma.array(np.zeros(0))
    parts, start = [], 0
    for end in ends[ends > 0]:
        reach = signals.take(pa.array(np.flatnonzero(lengths >= end)))
        parts.append(statistic(np.array([row[start:end] for row in reach.to_pylist()], dtype=float)))
        start = end
    return np.ma.concatenate(parts)


def _gathered(rows: DataFrame, keys: Sequence[str], statistic: Statistic, out: str) -> DataFrame:
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(out, T.ArrayType(T.DoubleType()))])
    n_keys = len(keys)

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        values = point_values(pa.concat_arrays([p.column(n_keys) for p in parts]), statistic)
        flat = pa.array(values.data, pa.float64(), mask=np.ma.getmaskarray(values))
        listed = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([*[parts[0].column(i).slice(0, 1) for i in range(n_keys)], listed], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # the key that may go on in the next batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for i in range(n_keys):
                codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change |= np.diff(codes) != 0
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = [batch.column(i)[a].as_py() for i in range(n_keys)]
                if held and now != last:
                    yield row(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield row(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def per_key(signals: DataFrame, keys: Sequence[str], statistic: Statistic, by_points: Points, features: str = "features",
            gather: int = GATHER) -> tuple[DataFrame, DataFrame]:
    """(keys, values) of the keys that fit one task, and (keys, pos, value) of the others.

    ``by_points`` computes the same statistic from (keys, pos, value) rows.
    """
    keys = list(keys)
    used = signals.where(F.col(features).isNotNull()).select(*keys, F.col(features).cast("array<double>").alias("_x"))
    sizes = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.where(F.col("_n") > gather).select(*[F.col(k).alias(f"_big_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_big_{k}")) for k in keys]
    missing = F.coalesce("value", F.lit(float("nan"))).alias("value")
    exploded = used.join(big, same, "left_semi").select(*keys, F.posexplode("_x").alias("pos", "value")).select(
        *keys, F.col("pos").cast("long").alias("pos"), missing)
    return _gathered(used.join(big, same, "left_anti"), keys, statistic, "_values"), by_points(exploded)


def point_rows(signals: DataFrame, keys: Sequence[str], statistic: Statistic, by_points: Points, features: str = "features",
               gather: int = GATHER) -> DataFrame:
    """(keys, pos, value) rows."""
    small, large = per_key(signals, keys, statistic, by_points, features, gather)
    rows = small.select(*keys, F.posexplode("_values").alias("pos", "value"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "value").unionByName(large)
