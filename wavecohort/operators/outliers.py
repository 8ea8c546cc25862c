"""Principal components and outlier rules built on moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.functions import arrays as A
from wavecohort.models import linear
from wavecohort.models.linear import Pca, Stats
from wavecohort.functions.batch import features_matrix, list_array
from wavecohort.operators.moments import moments
from wavecohort.operators.sets import join_null_safe

# Rows of a sample up to which one task scores it whole.
GATHER = 20_000


def stats_rows(table: DataFrame, keys: Sequence[str]) -> dict:
    """Moments per key, on the driver: one d x d matrix per key of a bounded key set."""
    rows = table.toArrow()
    return {
        tuple(rows.column(k)[i].as_py() for k in keys): Stats.of(
            rows.column("n")[i].as_py(), rows.column("mean")[i].values.to_numpy(), rows.column("scatter")[i].values.to_numpy())
        for i in range(rows.num_rows)
    }


def total_stats(signals: DataFrame, features: str = "features") -> Stats:
    return stats_rows(moments(signals, [], features), [])[()]


def pca(signals: DataFrame, variance: float = 0.95, max_components: int = 15, features: str = "features") -> Pca:
    """Fit on the rows given.  One distributed pass; the d x d eigenproblem is solved on the driver."""
    return linear.pca_fit(total_stats(signals, features), variance, max_components)


def pca_standardized(signals: DataFrame, variance: float = 0.95, max_components: int = 10_000,
                     features: str = "features") -> tuple[Pca, np.ndarray]:
    """Fit on scaled signals: (components, sigma); mean and sigma are both kept for later rows."""
    s = total_stats(signals, features)
    _, sigma = linear.scale_params(np.eye(len(s.mean)), s)
    fit = linear.pca_fit(Stats(s.n, s.mean / sigma, s.scatter / np.outer(sigma, sigma)), variance, max_components)
    return Pca(s.mean, fit.coeff / sigma[:, None], fit.explained, fit.latent), sigma


def pca_table(signals: DataFrame, fit: Pca) -> DataFrame:
    """Components as rows: number, explained percent, loadings."""
    rows = [(i + 1, float(fit.explained[i]), float(fit.latent[i]), fit.coeff[:, i].tolist()) for i in range(len(fit.explained))]
    return signals.sparkSession.createDataFrame(rows, "k long, explained double, latent double, loadings array<double>")


def cumulative_explained(components: DataFrame) -> DataFrame:
    """Running sum of the explained percent; one row per component, at most the axis length."""
    w = W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return components.select("k", "explained", F.sum("explained").over(w).alias("cumulative"))


def components_needed(components: DataFrame, variance: float, max_components: int) -> DataFrame:
    """First component whose cumulative share reaches the threshold, else all; between 1 and the maximum."""
    c = cumulative_explained(components)
    first = F.coalesce(F.min(F.when(F.col("cumulative") >= variance * 100, F.col("k"))), F.max("k"))
    return c.agg(F.greatest(F.lit(1), F.least(first, F.lit(max_components))).cast("long").alias("n_components"))


def top_components(components: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` explained values (scree table)."""
    return components.select("k", "explained").orderBy("k").limit(n)


def pca_truncate(components: DataFrame, n: int = 15) -> DataFrame:
    """Reuse the first components of a stored fit, with their cumulative percent."""
    return cumulative_explained(components.where(F.col("k") <= n))


def project(signals: DataFrame, keep: Sequence[str], mean: np.ndarray, coeff: np.ndarray, features: str = "features",
            residual: bool = False) -> DataFrame:
    """(keep, scores[, q]): (x - mean) . coeff and, on request, the squared residual.

    One matrix product per Arrow batch; the loadings (signal length x components) travel with the task.
    """
    fields = [signals.schema[c] for c in keep] + [T.StructField("pc", T.ArrayType(T.DoubleType()))]
    if residual:
        fields.append(T.StructField("q", T.DoubleType()))
    names = [f.name for f in fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = features_matrix(batch.column(n_keep)) - mean
            t = x @ coeff
            cols = [*[batch.column(i) for i in range(n_keep)], list_array(t)]
            if residual:
                rest = x - t @ coeff.T
                cols.append(pa.array(np.einsum("ij,ij->i", rest, rest)))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return signals.select(*keep, F.col(features).cast("array<double>").alias("_x")).mapInArrow(run, T.StructType(fields))


def pca_scatter(signals: DataFrame, fit: Pca, keep: Sequence[str], features: str = "features") -> DataFrame:
    """First two components next to the kept columns."""
    p = project(signals, keep, fit.mean, fit.coeff, features)
    return p.select(*keep, F.col("pc")[0].alias("pc1"), F.coalesce(F.get("pc", F.lit(1)), F.lit(0.0)).alias("pc2"))


def squared_distance(rows: DataFrame, centres: dict, inverses: dict, key: str | None, keep: Sequence[str]) -> DataFrame:
    """Mahalanobis d^2 of component scores to the centre of the row's key.

    ``centres`` and ``inverses`` hold at most one entry per class.
    """
    fields = [rows.schema[c] for c in keep] + [T.StructField("d2", T.DoubleType())]
    names = [f.name for f in fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = features_matrix(batch.column(n_keep))
            d2 = np.full(len(t), np.nan)
            ids = batch.column(n_keep + 1).to_numpy(zero_copy_only=False) if key else np.zeros(len(t))
            for k in np.unique(ids):
                code = (k.item() if hasattr(k, "item") else k) if key else None
                if code in centres:
                    z = t[ids == k] - centres[code]
                    d2[ids == k] = np.einsum("ij,jk,ik->i", z, inverses[code], z, optimize=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n_keep)], pa.array(d2)], names=names)

    extra = [F.col(key).alias("_key")] if key else []
    return rows.select(*keep, F.col("pc").alias("_t"), *extra).mapInArrow(run, T.StructType(fields))


def mahalanobis_within(signals: DataFrame, sample: str, keep: Sequence[str], max_components: int = 10,
                       features: str = "features", among: Column | None = None, gather: int = GATHER) -> DataFrame:
    """(keep, d2, n_components, is_outlier): distance inside the sample, in up to ten of its own components.

    Rows are shuffled to their sample once and scored there.  With components
    u_k of unit length over the rows of a sample, d^2 of row i is (n - 1) times
    the sum of u_ik^2, and they come from the smaller of the two products of the
    centred rows: n x n for fewer signals than points, else points x points.
    Samples of more than ``gather`` rows, found by a count that reads no
    signal, are never in one task: they go through moments and a second pass.

    Only rows for which ``among`` is true make up the sample; the others have
    NULL as distance and are no outliers.  A sample with fewer than three such
    signals has no outlier, nor has one with values that are not finite.
    """
    inside = F.coalesce(among, F.lit(False)) if among is not None else F.lit(True)
    marked = signals.withColumn("_in", inside)
    size = marked.where("_in").groupBy(F.col(sample).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    big = size.where(F.col("_n") > gather).select("_s")
    used = marked.where("_in")
    out = _within_rows(used.join(big, used[sample].eqNullSafe(big["_s"]), "left_anti"), sample, keep, max_components, features)
    out = out.unionByName(_within_moments(used.join(big, used[sample].eqNullSafe(big["_s"]), "left_semi"), sample, keep,
                                          max_components, features))
    if among is None:
        return out
    rest = marked.where("not _in").select(
        *keep, F.lit(None).cast("double").alias("d2"), F.lit(None).cast("long").alias("n_components"), F.lit(False).alias("is_outlier"))
    return out.unionByName(rest)


def row_distances(x: np.ndarray, max_components: int) -> tuple[np.ndarray, int]:
    """Squared distance of each row from the mean of all, and the number of components it is made of."""
    n = len(x)
    if n < 3 or not np.isfinite(x).all():
        return np.full(n, 0.0 if n < 3 else np.nan), 0
    c = x - x.mean(axis=0)
    dual = n < c.shape[1]
    values, vectors = np.linalg.eigh(c @ c.T if dual else c.T @ c)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[: min(max_components, n - 1)] > 1e-10 * max(values[0], 1e-300)).sum())
    u = vectors[:, :k] if dual else (c @ vectors[:, :k]) / np.sqrt(values[:k])
    return (n - 1) * np.einsum("ij,ij->i", u, u), k


def _within_rows(rows: DataFrame, sample: str, keep: Sequence[str], max_components: int, features: str) -> DataFrame:
    """Distances of samples that fit one task."""
    limits = linear.CHI2_99
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("d2", T.DoubleType()),
                           T.StructField("n_components", T.LongType()), T.StructField("is_outlier", T.BooleanType())])
    n_keep = len(keep)

    def scored(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([features_matrix(p.column(n_keep)) for p in parts])
        d2, k = row_distances(x, max_components)
        limit = limits[k - 1] if 0 < k <= len(limits) else float("inf")
        cols = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(n_keep)]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(d2), pa.array(np.full(len(x), k, np.int64)), pa.array(d2 > limit)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = [], None  # the sample that may go on in the next batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = batch.column(n_keep + 1)
            codes = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = key[a].as_py()
                if open_ and now != last:
                    yield scored(open_)
                    open_ = []
                open_.append(batch.slice(a, b - a))
                last = now
        if open_:
            yield scored(open_)

    placed = rows.select(*keep, F.col(features).cast("array<double>").alias("_x"), F.col(sample).alias("_sample"))
    return placed.repartition("_sample").sortWithinPartitions("_sample").mapInArrow(run, schema)


def _within_moments(signals: DataFrame, sample: str, keep: Sequence[str], max_components: int, features: str) -> DataFrame:
    """Distances of samples of any size: moments give a sample's components in one row, and rows are joined with them."""
    limits = linear.CHI2_99
    table = moments(signals, [sample], features, gather=GATHER)
    schema = T.StructType([
        signals.schema[sample], T.StructField("_mean", T.ArrayType(T.DoubleType())),
        T.StructField("_load", T.ArrayType(T.DoubleType())), T.StructField("n_components", T.LongType()),
        T.StructField("_limit", T.DoubleType()),
    ])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f.name: [] for f in schema.fields}
            for i in range(batch.num_rows):
                s = Stats.of(batch.column("n")[i].as_py(), batch.column("mean")[i].values.to_numpy(),
                             batch.column("scatter")[i].values.to_numpy())
                fit = linear.pca_fit(s, 1.1, max_components)
                use = fit.latent > 1e-10 * max(fit.latent[0], 1e-300)
                k = int(use.sum()) if s.n > 2 else 0
                scaled = (fit.coeff[:, :k] / np.sqrt(fit.latent[:k])).T if k else np.zeros((0, len(s.mean)))
                for name, v in zip(out, (batch.column(sample)[i].as_py(), s.mean, scaled.ravel(), k,
                                         limits[k - 1] if k else float("inf"))):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[sample], batch.column(sample).type), pa.array(out["_mean"], pa.list_(pa.float64())),
                 pa.array(out["_load"], pa.list_(pa.float64())), pa.array(out["n_components"], pa.int64()),
                 pa.array(out["_limit"], pa.float64())], names=list(out))

    params = table.mapInArrow(solve, schema)
    # d^2 = sum over components of (x - mean) . load: row-local once the sample's row is attached
    x = F.zip_with(F.col(features), F.col("_mean"), lambda a, m: a - m)
    rows = join_null_safe(signals, params, [sample]).withColumn("_c", x)
    width = F.size("_mean")
    parts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("n_components").cast("int"), F.lit(1))),
        lambda j: F.aggregate(
            F.zip_with(F.slice(F.col("_load"), (j - 1) * width + 1, width), F.col("_c"),
                       lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v),
    )
    d2 = F.aggregate(parts, F.lit(0.0), lambda acc, t: acc + t * t)
    return rows.withColumn("d2", d2).select(
        *keep, "d2", "n_components", (F.col("d2") > F.col("_limit")).alias("is_outlier"))


def class_distance_model(train: DataFrame, label: str, max_components: int = 10, features: str = "features"):
    """(pca, centres, inverses) of training representatives per class; inputs to the two rules below."""
    by_class = stats_rows(moments(train, [label], features), [label])
    whole = linear.pooled(list(by_class.values()))
    fit = linear.pca_fit(whole, 0.95, max_components)
    c = fit.coeff.T
    mapped = {k[0]: s.mapped(c, -c @ fit.mean) for k, s in by_class.items()}
    centres = {k: s.mean for k, s in mapped.items()}
    inverses = {k: linear.invert(s.scatter / max(s.n - 1, 1)) for k, s in mapped.items()}
    return fit, whole, centres, inverses


def mahalanobis_by_class(train: DataFrame, label: str, keep: Sequence[str], max_components: int = 10,
                         features: str = "features") -> DataFrame:
    """Distance of each training row to its own class; at most the farthest row of a class is removed."""
    fit, _, centres, inverses = class_distance_model(train, label, max_components, features)
    cols = list(dict.fromkeys([*keep, label]))
    d = squared_distance(project(train, cols, fit.mean, fit.coeff, features), centres, inverses, label, cols)
    limit = linear.CHI2_99[len(fit.explained) - 1]
    # the farthest row per class by a map-side maximum
    far = d.groupBy(label).agg(F.max_by(F.struct(*keep), F.struct("d2", *keep)).alias("_far"))
    return d.join(far, label).select(
        *cols, "d2", ((F.struct(*keep) == F.col("_far")) & (F.col("d2") > limit)).alias("is_removed"))


def mahalanobis_test_info(train: DataFrame, test: DataFrame, label: str, keep: Sequence[str], max_components: int = 10,
                          features: str = "features") -> DataFrame:
    """Distance of test rows to the whole training distribution; information only, nothing is removed."""
    fit, whole, _, _ = class_distance_model(train, label, max_components, features)
    c = fit.coeff.T
    cov = whole.mapped(c, -c @ fit.mean).scatter / max(whole.n - 1, 1)
    rows = project(test, keep, fit.mean, fit.coeff, features)
    d = squared_distance(rows, {None: np.zeros(len(cov))}, {None: linear.invert(cov)}, None, keep)
    return d.withColumn("is_far", F.col("d2") > linear.CHI2_99[len(cov) - 1])


def t2_q(signals: DataFrame, fit: Pca, keep: Sequence[str], features: str = "features") -> DataFrame:
    """(keep, t2, q) of each row under a fit."""
    p = project(signals, keep, fit.mean, fit.coeff, features, residual=True)
    lam = A.doubles([max(float(v), 1e-300) for v in fit.latent])
    return p.select(*keep, F.aggregate(F.zip_with("pc", lam, lambda t, v: t * t / v), F.lit(0.0), lambda a, b: a + b).alias("t2"), "q")


def t2_q_outliers(train: DataFrame, keep: Sequence[str], n_components: int = 5, features: str = "features") -> DataFrame:
    """Rows whose T2 and Q both exceed mean + 3 std, thresholds and fit from the training rows given."""
    fit = pca(train, 1.1, n_components, features)
    rows = t2_q(train, fit, keep, features)
    limits = rows.agg((F.avg("t2") + 3 * F.stddev_samp("t2")).alias("t2_limit"), (F.avg("q") + 3 * F.stddev_samp("q")).alias("q_limit"))
    both = rows.withColumn("_k", F.lit(0)).join(F.broadcast(limits.withColumn("_k", F.lit(0))), "_k").drop("_k")
    out_t, out_q = F.col("t2") > F.col("t2_limit"), F.col("q") > F.col("q_limit")
    return both.withColumns({"outlier_t2": out_t, "outlier_q": out_q, "outlier_both": out_t & out_q})
