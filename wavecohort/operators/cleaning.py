"""Row selection, validation, deduplication and joins of raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecohort.functions import arrays as A
from wavecohort.functions.labels import make_key, session_number
from wavecohort.operators.sets import join_null_safe


def explode_signals(samples: DataFrame, spectra: str = "spectra", keep: Sequence[str] = ()) -> DataFrame:
    """One row per signal of a nested sample row, with its 1-based index inside the sample."""
    kept = list(keep) or [c for c in samples.columns if c != spectra]
    return samples.select(*kept, F.posexplode(spectra).alias("_pos", "features")).select(
        *kept, (F.col("_pos") + 1).cast("long").alias("local_index"), "features"
    )


def long_form(signals: DataFrame, axis: Sequence[float], keys: Sequence[str], features: str = "features") -> DataFrame:
    """One row per (signal, axis point)."""
    points = A.doubles(axis)
    checked = F.when(F.size(features) == len(axis), F.col(features)).otherwise(
        F.raise_error(F.lit("signal length differs from the axis length"))
    )
    zipped = F.arrays_zip(points.alias("axis"), checked.alias("value"))
    return signals.select(*keys, F.posexplode(zipped).alias("pos", "p")).select(
        *keys, F.col("pos").cast("long").alias("pos"), F.col("p.axis").alias("axis"), F.col("p.value").alias("value")
    )


def axis_table(df: DataFrame, axis: Sequence[float]) -> DataFrame:
    """(pos, axis) rows of a fixed axis."""
    spark = df.sparkSession
    points = A.doubles(axis)
    return spark.range(1).select(F.posexplode(points).alias("pos", "axis")).select(
        F.col("pos").cast("long").alias("pos"), "axis"
    )


def axis_join(long: DataFrame, axis: DataFrame) -> DataFrame:
    """Attach axis values by position.  The axis table has one row per array element; the planner picks the join."""
    return long.join(axis, "pos")


def rename_drop(samples: DataFrame, renames: dict[str, str], drops: Sequence[str]) -> DataFrame:
    return samples.withColumnsRenamed(renames).drop(*drops)


def filter_labels(df: DataFrame, label: str, allowed: Sequence) -> DataFrame:
    return df.where(F.col(label).isin(*allowed))


def nan_remove(df: DataFrame, features: str = "features") -> DataFrame:
    return df.where(~A.has_nan(F.col(features)))


def nan_error(df: DataFrame, features: str = "features") -> DataFrame:
    """Fail the query on the first signal holding a NaN; checked while the rows are read."""
    checked = F.when(A.has_nan(F.col(features)), F.raise_error(F.lit("NaN found in a signal"))).otherwise(
        F.col(features)
    )
    return df.withColumn(features, checked)


def column_means(df: DataFrame, keys: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Mean per axis point over its non-NaN values, as one array per key (length of the axis, so bounded)."""
    points = df.select(*keys, F.posexplode(features).alias("pos", "v"))
    per_point = points.groupBy(*keys, "pos").agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("m"))
    return per_point.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("means")
    )


def nan_impute(df: DataFrame, features: str = "features") -> DataFrame:
    """Replace NaN by the mean of its column; a column without any value stays NaN."""
    key = F.lit(0).alias("_k")
    means = column_means(df, features=features).withColumn("_k", F.lit(0))
    fill = F.zip_with(
        F.col(features), F.col("means"), lambda v, m: F.when(F.isnan(v), F.coalesce(m, F.lit(float("nan")))).otherwise(v)
    )
    # one row, one array of axis length: a bounded broadcast
    return df.withColumn("_k", key).join(F.broadcast(means), "_k").withColumn(features, fill).drop("_k", "means")


def nan_policy(df: DataFrame, policy: str, features: str = "features") -> DataFrame:
    choices = {"error": nan_error, "remove": nan_remove, "impute": nan_impute}
    if policy not in choices:
        raise ValueError(f"unknown NaN policy: {policy}")
    return choices[policy](df, features)


def validate_signals(
    df: DataFrame, sample: str, label: str, allowed: Sequence, features: str = "features", width: int | None = None
) -> DataFrame:
    """One row of violation counts: empty, wrong width, not finite, unknown label.

    Without ``width`` signals are compared with the longest one.
    """
    wrong = F.col("widest") != F.col("narrowest") if width is None else F.col("off_width") > 0
    # flags first: the distinct counts below copy the columns they see, and signals are wide
    flags = df.select(
        F.col(sample).alias("_s"), F.col(label).alias("_l"), F.size(features).alias("_w"),
        (A.nonfinite_count(F.col(features)) > 0).alias("_bad"),
    )
    total = lambda c: F.sum(c.cast("long"))
    counts = flags.agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.countDistinct("_s").alias("n_samples"),
        total(F.col("_w") <= 0).alias("n_empty"),
        F.max("_w").alias("widest"),
        F.min("_w").alias("narrowest"),
        total(F.col("_w") != F.lit(width if width is not None else -1)).alias("off_width"),
        total(F.col("_bad")).alias("n_nonfinite"),
        total(~F.coalesce(F.col("_l").isin(*allowed), F.lit(False))).alias("n_bad_label"),
        F.countDistinct("_l").alias("n_classes"),
    )
    return counts.select(
        "n_signals", "n_samples", "n_empty", wrong.alias("mixed_width"), "n_nonfinite", "n_bad_label",
        "n_classes", (F.col("n_classes") >= 2).alias("enough_classes"),
        (F.col("widest") >= 10).alias("enough_features"),
    )


def duplicate_ids(df: DataFrame, key: str, listed: int | None = None) -> DataFrame:
    """Ids occurring more than once, in id order; ``listed`` limits the report, as a top-k listing."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    return dup if listed is None else dup.orderBy(key).limit(listed)


def apply_qc_mask(signals: DataFrame, mask: DataFrame, keys: Sequence[str], flagged_samples: DataFrame | None = None,
                  sample: str = "sample_id") -> DataFrame:
    """Keep valid signals of samples that are not flagged; a signal without a mask row is valid."""
    kept = signals.join(mask.select(*keys, "is_valid"), list(keys), "left").where(
        F.coalesce(F.col("is_valid"), F.lit(True))
    ).drop("is_valid")
    if flagged_samples is not None:
        kept = kept.join(flagged_samples.select(sample).distinct(), sample, "left_anti")
    return kept


def emptied_samples(before: DataFrame, after: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples that lost all their signals."""
    return before.select(sample).distinct().join(after.select(sample).distinct(), sample, "left_anti")


def dedup_lowest_session(positions: DataFrame, probe: str, position: str, source_file: str,
                         tie: Sequence[str]) -> DataFrame:
    """Keep the row with the lowest session number per (probe, position).

    The winners are found on the narrow order columns, combined map-side, so a
    heavily repeated key is no hot spot and whole rows never enter an
    aggregate; then the rows are picked.  ``tie`` has to tell apart the rows of
    one key and file: rows equal in it are all kept.
    """
    keyed = positions.withColumn("dedup_key", make_key(F.col(probe), F.col(position))).withColumn(
        "session", session_number(F.col(source_file))
    )
    order = F.struct("session", source_file, *tie)
    best = keyed.groupBy("dedup_key").agg(F.min(order).alias("_best"))
    kept = join_null_safe(keyed, best, ["dedup_key"]).where(order.eqNullSafe(F.col("_best")))
    return kept.select("dedup_key", *[c for c in keyed.columns if c != "dedup_key"])


def join_metadata(positions: DataFrame, meta: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on the trimmed text key; columns of ``meta`` already present on the left are left out.

    No broadcast hint: the planner broadcasts the metadata only when its size allows it.
    """
    left = positions.withColumn("_k", F.trim(F.col(left_key).cast("string")))
    extra = [c for c in meta.columns if c != right_key and c not in positions.columns]
    right = meta.select(F.trim(F.col(right_key).cast("string")).alias("_k"), *extra)
    return left.join(right, "_k").drop("_k")


def join_outlier_flags(signals: DataFrame, flags: DataFrame, probe: str, pos: str, flag: str) -> DataFrame:
    """Drop flagged signals.

    A probe keeps all its signals when it has no flags or when the number of
    flags differs from the number of signals.  Both counts are pre-aggregated.
    """
    n_left = signals.groupBy(probe).agg(F.count(F.lit(1)).alias("_n_signals"))
    n_right = flags.groupBy(probe).agg(F.count(F.lit(1)).alias("_n_flags"))
    usable = n_left.join(n_right, probe).where(F.col("_n_signals") == F.col("_n_flags")).select(
        probe, F.lit(True).alias("_usable")
    )
    bad = flags.where(F.col(flag)).select(probe, pos).distinct().join(usable, probe, "left_semi")
    return signals.join(bad, [probe, pos], "left_anti")


def combine_positions(positions: DataFrame, sample: str, position: str, spectra: str) -> tuple[DataFrame, DataFrame]:
    """Combine the positions of each sample.

    Returns (signals, counts).  The combined matrix stays one row per signal,
    numbered inside its position: a sample may hold any number of positions, so
    it is never gathered into one array.  ``counts`` has the number of positions
    and of signals per sample.
    """
    signals = positions.select(sample, position, F.posexplode(spectra).alias("_i", "features")).select(
        sample, position, (F.col("_i") + 1).cast("long").alias("signal_pos"), "features"
    )
    counts = positions.groupBy(sample).agg(
        F.count(F.lit(1)).alias("num_positions"), F.sum(F.size(spectra)).cast("long").alias("num_spectra")
    )
    return signals, counts


def first_meta_row(positions: DataFrame, sample: str, meta: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Metadata of the first position row per sample, in the given order."""
    return positions.groupBy(sample).agg(F.min_by(F.struct(*meta), F.struct(*order)).alias("m")).select(sample, "m.*")


def carry_metadata(samples: DataFrame, spectra: str, keep: Sequence[str]) -> DataFrame:
    """Selected metadata next to the number of signals of each sample row."""
    return samples.select(*keep, F.size(spectra).cast("long").alias("n_spectra"))


def misclassified(preds: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return preds.where(F.col(true) != F.col(pred))
