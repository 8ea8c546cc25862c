"""Operator 10: quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; every document is unlabelled
text.  A linear model over the shape of a text (kinds of bytes, forms of words,
repetition, lines) minimises the unbiased risk with logistic loss,

    pi * E_P[l(f)] + (E_U[l(-f)] - pi * E_P[l(-f)]),

where the bracket, the risk on negatives, may not become negative (Kiryo et
al., 2017): a step that would make it so is shortened.  The class prior pi is
estimated by the share of unlabelled text among texts that look most like
positives (best bin, Garg et al., 2021).  Labelled negatives are never read.

All documents take part: features are stored once as a narrow table, and each
Newton step is one aggregate over it; the driver sees sums only, whose number
depends on the number of features.  Scores are computed from the text in one
further scan, without a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.llm import text as X
from wavecohort.llm.stored import scratch, stored

KINDS = 9  # upper, lower, digit, beyond ASCII, stop, exclamation, bar, symbol, other
WIDTH = 1 + 15 + KINDS * KINDS
RIDGE = 1e-3
STEPS = 12
START_PRIOR = 0.5
BINS = 2000


def _kinds() -> np.ndarray:
    kind = np.full(256, 8, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 0, 1, 2, 3
    for chars, k in ((b".,;:?", 4), (b"!", 5), (b"|", 6), (b"#$%&*@^~<>{}[]=+\\/", 7)):
        kind[list(chars)] = k
    return kind


KIND = _kinds()


def _shares(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of ``value`` over each [offsets[i], offsets[i + 1]); 0 where empty."""
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, WIDTH) float32; every column is bounded, the first is constant.  Empty texts give zeros after it."""
    start, end, first = X.words(data, offsets)
    docs = len(offsets) - 1
    out = np.zeros((docs, WIDTH))
    out[:, 0] = 1
    kind = KIND[data]
    for k in range(KINDS - 1):
        out[:, 1 + k] = _shares(kind == k, offsets)
    size = end - start
    h = X.span_hashes(data, start, end)
    owner = np.repeat(np.arange(docs), np.diff(first))
    n_words = np.diff(first)
    out[:, 9] = np.log1p(n_words) / 10
    out[:, 10] = np.minimum(_shares(size, first), 50) / 10
    out[:, 11] = np.minimum(np.sqrt(np.maximum(_shares(np.minimum(size, 100.0) ** 2, first) - _shares(np.minimum(size, 100), first) ** 2, 0)), 50) / 10
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out[:, 12] = _shares(same, first)
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[:, 13] = _shares(fresh, first) * (n_words > 0)
    low, high, line = X.runs(data != 10, offsets)
    lines = X.span_hashes(data, low, high)
    who = np.repeat(np.arange(docs), np.diff(line))
    order = np.lexsort((lines, who))
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (who[order][1:] == who[order][:-1])
    out[:, 14] = _shares(again, line)
    out[:, 15] = np.minimum(n_words / np.maximum(np.diff(line), 1), 200) / 100
    form = KIND[data[start]] * KINDS + KIND[data[end - 1]]
    counts = np.bincount(owner * KINDS * KINDS + form, minlength=docs * KINDS * KINDS).reshape(docs, -1)
    out[:, 16:] = counts / np.maximum(n_words, 1)[:, None]
    return out.astype(np.float32)


def _features_of(column) -> np.ndarray:
    parts = [features(d, o) for _, _, d, o in X.slices(X.plain(column))]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) of whole texts."""
    def run(batches):
        for b in batches:
            x = _features_of(b.column(1))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, WIDTH, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        X.trimmed(run), f"id {kind}, x array<float>")


def _sums(train: DataFrame, fn, size: int) -> np.ndarray:
    """Sum of ``fn(x, positive)`` (vectors of ``size``) over all batches, added up by Spark."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)
                total += fn(x, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = train.select("x", "positive").mapInArrow(X.trimmed(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _softplus(f: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, f)


def _minimise(train: DataFrame, prior: float, n: float, n_pos: float, mean_pos: np.ndarray, steps: int) -> np.ndarray:
    """Weights of least non-negative unbiased risk."""
    upper = np.triu_indices(WIDTH)
    w = np.zeros(WIDTH)
    scales = 0.5 ** np.arange(8)
    penalty = np.full(WIDTH, RIDGE)
    penalty[0] = 1e-6

    def slope(x, _):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        return np.concatenate([x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x)[upper]])

    last = None
    for _ in range(steps):
        got = _sums(train, slope, WIDTH + len(upper[0])) / n
        hess = np.zeros((WIDTH, WIDTH))
        hess[upper] = got[WIDTH:]
        hess = hess + np.triu(hess, 1).T + np.diag(penalty)
        step = -np.linalg.solve(hess, got[:WIDTH] - prior * mean_pos + penalty * w)
        tries = w + scales[:, None] * step

        def losses(x, p):
            l = _softplus(x @ tries.T)
            return np.concatenate([l.sum(0), (l * p[:, None]).sum(0)])

        got = _sums(train, losses, 2 * len(scales))
        negative = got[: len(scales)] / n - prior * got[len(scales):] / n_pos
        risk = got[: len(scales)] / n - prior * tries @ mean_pos + 0.5 * (tries ** 2 @ penalty)
        allowed = np.where(negative >= 0, risk, np.inf)
        best = int(np.argmin(allowed))
        if not np.isfinite(allowed[best]) or (last is not None and last - allowed[best] < 1e-6 * max(1, abs(last))):
            break
        w, last = tries[best], allowed[best]
    return w


def _best_bin(train: DataFrame, w: np.ndarray, n: float, n_pos: float) -> float:
    """Class prior: least ratio of unlabelled to positive mass above a score, with the sampling error of both."""
    def hist(x, p):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        at = np.minimum((s * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=p, minlength=BINS)])

    got = _sums(train, hist, 2 * BINS)
    above = np.cumsum(got[:BINS][::-1]) / n
    above_pos = np.cumsum(got[BINS:][::-1]) / n_pos
    error = np.sqrt(np.log(40) / 2 / n) + np.sqrt(np.log(40) / 2 / n_pos)
    ratio = np.where(above_pos > 0, (above + error) / np.maximum(above_pos, 1e-12), np.inf)
    k = int(np.argmin(ratio))
    return float(np.clip(above[k] / above_pos[k], 0.01, 0.99)) if np.isfinite(ratio[k]) else START_PRIOR


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, class prior).

    ``positives`` holds the ids (column ``id_col``) of trusted documents; ids
    without a document, repeated and null ids change nothing.  Without any
    positive or any document the model is 0 and every score is 0.5.
    """
    with scratch(docs.sparkSession):
        trusted = positives.select(F.col(id_col).alias("id")).filter("id is not null").distinct().withColumn("p", F.lit(1.0))
        train = stored(feature_table(docs, id_col, text_col).join(trusted, "id", "left").select(
            "x", F.coalesce("p", F.lit(0.0)).alias("positive")), "features")
        got = _sums(train, lambda x, p: np.concatenate([[len(x), p.sum()], p @ x]), 2 + WIDTH)
        n, n_pos = got[0], got[1]
        if not n or not n_pos:
            return np.zeros(WIDTH), START_PRIOR
        mean_pos = got[2:] / n_pos
        prior = _best_bin(train, _minimise(train, START_PRIOR, n, n_pos, mean_pos, steps), n, n_pos)
        return _minimise(train, prior, n, n_pos, mean_pos, steps), prior


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row; columns, nulls and repeated rows stay as they are.

    A null text counts as empty; a column already named ``out_col`` is replaced.
    """
    kept = [c for c in docs.columns if c != out_col]
    at = kept.index(text_col)

    def run(batches):
        for b in batches:
            f = _features_of(b.column(at)).astype(np.float64) @ weights
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(f, -500, 500))))], [*kept, out_col])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out_col, T.DoubleType())])
    return docs.select(*kept).mapInArrow(X.trimmed(run), schema)


def good_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids whose every label is 1."""
    return labels.groupBy(id_col).agg(F.min(F.coalesce(label_col, F.lit(0))).alias("l")).filter("l = 1").select(id_col)
