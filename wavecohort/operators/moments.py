"""Count, mean and scatter of signals per key, in one pass.

PCA, discriminant analysis and partial least squares depend on the data only
through these, and the moments of a fixed linear transform of the signals follow
from those of the raw signals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.functions.batch import features_matrix
from wavecohort.operators.sets import join_null_safe

# A task keeps one accumulator per key up to this size; beyond it, it sends what it has and starts again.
STATE_BYTES = 256 * 1024 * 1024
# Partials of one key are merged in two steps; the first spreads them over so many tasks.
SPREAD = 64


def moments(signals: DataFrame, keys: Sequence[str], features: str = "features",
            fold_array: str | None = None, gather: int | None = None) -> DataFrame:
    """(keys[, repeat, fold], n, mean, scatter): count, mean and flattened centred cross-product.

    Every batch is centred on its own mean, and partial results are merged by
    the exact update for unions, so nothing cancels wherever the data lie.  With
    ``fold_array`` (fold number per repeat) each signal counts once per repeat.

    A task sends one partial per key whatever its number of rows, so the shuffle
    grows with tasks x keys and not with the data.  Partials are merged in two
    steps, so that no merge task reads those of all tasks.

    That holds for few keys (classes, folds).  For keys that grow with the data,
    such as samples, give ``gather``: rows are then shuffled to their key first,
    a key with more than ``gather`` rows in as many parts as it needs.
    """
    keys = list(keys)
    by_fold = fold_array is not None
    taken = signals.select(*keys, *([fold_array] if by_fold else []), F.col(features).cast("array<double>").alias("_x"))
    if gather is not None:
        sizes = signals.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / gather).alias("_parts"))
        # the part follows from the row itself, so a recomputed task sends it to the same place
        part = F.pmod(F.xxhash64("_x"), F.col("_parts"))
        parted = join_null_safe(taken, sizes, keys).withColumn("_part", part)
        taken = parted.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").select(*taken.columns)
    key_fields = [taken.schema[k] for k in keys]
    if by_fold:
        key_fields += [T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType())]
    schema = T.StructType([
        *key_fields, T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("scatter", T.ArrayType(T.DoubleType())),
    ])
    names = [f.name for f in key_fields]
    n_keys = len(keys)
    arrow_schema = pa.schema(
        [pa.field(f.name, _arrow_type(f.dataType)) for f in key_fields]
        + [pa.field("n", pa.int64()), pa.field("mean", pa.list_(pa.float64())), pa.field("scatter", pa.list_(pa.float64()))]
    )

    def emit(state: dict) -> Iterator[pa.RecordBatch]:
        for key, (n, mean, scatter) in state.items():
            cols = [pa.array([v], type=f.type) for v, f in zip(key, arrow_schema)]
            cols += [pa.array([n], pa.int64()), pa.array([mean], pa.list_(pa.float64())),
                     pa.array([scatter.ravel()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    def add(state: dict, key: tuple, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        if key in state:
            m, old_mean, old_scatter = state[key]
            step = mean - old_mean
            scatter = old_scatter + scatter + (np.outer(step, step) * (m * n / (m + n))).reshape(scatter.shape)
            n, mean = m + n, old_mean + step * (n / (m + n))
        state[key] = (n, mean, scatter)

    def add_rows(state: dict, key: tuple, x: np.ndarray) -> None:
        mean = x.mean(axis=0)
        centred = x - mean
        add(state, key, len(x), mean, centred.T @ centred)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = features_matrix(batch.column(batch.num_columns - 1))
            codes, found = _codes([batch.column(i) for i in range(n_keys)], batch.num_rows)
            folds = features_matrix(batch.column(n_keys)) if by_fold else None
            for code, key in enumerate(found):
                rows = np.flatnonzero(codes == code)
                part = x[rows]
                if folds is None:
                    add_rows(state, key, part)
                    continue
                for r in range(folds.shape[1]):
                    mine = folds[rows, r]
                    for f in np.unique(mine):
                        sub = part[mine == f]
                        add_rows(state, (*key, r + 1, int(f)), sub)
            if len(state) * x.shape[1] ** 2 * 8 > STATE_BYTES:
                yield from emit(state)
                state = {}
        yield from emit(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        width = len(names)
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(j)[i].as_py() for j in range(width))
                mean = batch.column(width + 1)[i].values.to_numpy()
                scatter = batch.column(width + 2)[i].values.to_numpy()
                add(state, key, batch.column(width)[i].as_py(), mean, scatter)
                if gather is not None and len(state) * scatter.nbytes > STATE_BYTES:
                    current = state.pop(key)
                    yield from emit(state)
                    state = {key: current}
        yield from emit(state)

    if gather is not None:
        # partials of a key arrive next to each other, so a task may send a key once it is past it
        return taken.mapInArrow(accumulate, schema).repartition(*names).sortWithinPartitions(*names).mapInArrow(merge, schema)
    # the salt spreads the partials of one key; any spread gives the same result
    salted = taken.mapInArrow(accumulate, schema).withColumn("_salt", F.spark_partition_id() % SPREAD)
    partial = salted.repartition(*names, "_salt").drop("_salt").mapInArrow(merge, schema)
    target = [F.col(c) for c in names] or [F.lit(0)]
    return partial.repartition(*target).mapInArrow(merge, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    return {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
            "double": pa.float64(), "boolean": pa.bool_()}[t.simpleString()]


def _codes(columns: list, n: int) -> tuple[np.ndarray, list[tuple]]:
    """Row -> key number, and the distinct keys of a batch."""
    if not columns:
        return np.zeros(n, dtype=int), [()]
    combined = np.zeros(n, dtype=np.int64)
    encoded = []
    for c in columns:
        d = c.dictionary_encode()
        indices = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
        encoded.append((indices, d.dictionary.to_pylist() + [None]))
        combined = combined * (len(d.dictionary) + 1) + indices
    _, first, codes = np.unique(combined, return_index=True, return_inverse=True)
    return codes, [tuple(values[idx[row]] for idx, values in encoded) for row in first]
