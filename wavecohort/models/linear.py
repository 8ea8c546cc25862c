"""Linear models solved from moments.

Everything here works on a few ``d x d`` matrices (d is the signal length), never
on rows.  Fits take class moments, so one pass over the signals serves every
fold, recipe and classifier.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from wavecohort.functions.batch import smooth_weights


@dataclass(frozen=True)
class Stats:
    """Count, mean and centred scatter (n - 1 times the covariance) of a set of signals."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(n: int, mean, scatter) -> "Stats":
        mean = np.asarray(mean, dtype=float)
        return Stats(n, mean, np.asarray(scatter, dtype=float).reshape(len(mean), len(mean)))

    def mapped(self, t: np.ndarray, offset: np.ndarray) -> "Stats":
        return Stats(self.n, t @ self.mean + offset, t @ self.scatter @ t.T)


def pooled(parts: Sequence[Stats]) -> Stats:
    """Statistics of the union."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    scatter = sum(p.scatter + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    return Stats(n, mean, scatter)


# --- recipes as affine maps ------------------------------------------------------


def bin_matrix(d: int, width: int) -> np.ndarray:
    out = np.zeros((d // width, d))
    for i in range(d // width):
        out[i, i * width:(i + 1) * width] = 1.0 / width
    return out


def smooth_matrix(d: int, window: int, poly: int) -> np.ndarray:
    if d < window:
        return np.eye(d)
    hat = smooth_weights(window, poly)
    h = window // 2
    out = np.zeros((d, d))
    for i in range(d):
        first = min(max(i - h, 0), d - window)
        out[i, first:first + window] = hat[i - first]
    return out


def scale_params(t: np.ndarray, train: Stats) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of T x over the training signals; a zero deviation becomes 1."""
    mu = t @ train.mean
    var = np.sum((t @ train.scatter) * t, axis=1) / max(train.n - 1, 1)
    sigma = np.sqrt(np.maximum(var, 0.0))
    # a constant column leaves rounding noise of the size of its mean
    return mu, np.where(sigma <= 1e-12 * np.maximum(np.abs(mu), 1.0), 1.0, sigma)


def before_scale(recipe, d: int) -> np.ndarray:
    t = np.eye(d)
    if recipe.bin > 1:
        t = bin_matrix(d, recipe.bin)
    if recipe.smooth > 0:
        t = smooth_matrix(len(t), *recipe.smooth_window()) @ t
    return t


def recipe_map(recipe, train: Stats) -> tuple[np.ndarray, np.ndarray]:
    """(T, t) with recipe(x) = T x + t, its scaling taken from the training statistics."""
    t = before_scale(recipe, len(train.mean))
    offset = np.zeros(len(t))
    if recipe.scale:
        mu, sigma = scale_params(t, train)
        offset = -mu / sigma
        t = t / sigma[:, None]
    for _ in range(recipe.difference):
        t, offset = np.diff(t, axis=0), np.diff(offset)
    return t, offset


# --- fits ------------------------------------------------------------------------


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    coeff: np.ndarray
    explained: np.ndarray
    latent: np.ndarray


def pca_fit(stats: Stats, variance: float = 0.95, max_components: int = 15) -> Pca:
    """Components up to the first cumulative share >= ``variance``, at most ``max_components``, at least one.

    The sign of a component is fixed: its largest loading is positive.
    """
    latent, vectors = np.linalg.eigh(stats.scatter / max(stats.n - 1, 1))
    order = np.argsort(latent)[::-1][:max(min(len(latent), stats.n - 1), 1)]
    latent, vectors = np.maximum(latent[order], 0.0), vectors[:, order]
    total = latent.sum()
    explained = 100.0 * latent / total if total > 0 else np.zeros_like(latent)
    k = max(1, min(components_for(explained, variance), max_components, len(stats.mean)))
    coeff = vectors[:, :k]
    sign = np.sign(coeff[np.argmax(np.abs(coeff), axis=0), np.arange(k)])
    return Pca(stats.mean, coeff * np.where(sign == 0, 1.0, sign), explained[:k], latent[:k])


def components_for(explained: np.ndarray, variance: float) -> int:
    reached = np.flatnonzero(np.cumsum(explained) >= variance * 100.0)
    return int(reached[0]) + 1 if len(reached) else len(explained)


def invert(cov: np.ndarray) -> np.ndarray:
    """Inverse of a covariance; the pseudo-inverse when it is singular."""
    return np.linalg.pinv(cov, rcond=1e-12, hermitian=True)


def weighted_priors(counts: Mapping, positive, cost: float) -> dict:
    """Class shares with the positive class counted ``cost`` times."""
    weights = {c: n * (cost if c == positive else 1.0) for c, n in counts.items()}
    total = sum(weights.values())
    return {c: w / total for c, w in weights.items()}


def lda_weights(parts: Mapping, priors: Mapping | None = None, gamma: float = 0.0,
                delta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(d x K, K): linear discriminant per class, in the order of ``parts``.

    ``gamma`` moves the pooled covariance towards its diagonal, ``delta`` drops
    coefficients smaller in magnitude.
    """
    stats = list(parts.values())
    both = pooled(stats)
    within = sum(s.scatter for s in stats) / max(both.n - len(stats), 1)
    inverse = invert((1.0 - gamma) * within + gamma * np.diag(np.diag(within)))
    share = priors or {c: s.n / both.n for c, s in parts.items()}
    w = np.column_stack([inverse @ (s.mean - both.mean) for s in stats])
    w = np.where(np.abs(w) < delta, 0.0, w)
    b = np.array([np.log(share[c]) - 0.5 * (s.mean + both.mean) @ w[:, k] for k, (c, s) in enumerate(parts.items())])
    return w, b


@dataclass(frozen=True)
class Pls:
    beta: np.ndarray
    weights: np.ndarray
    x_loadings: np.ndarray
    y_loadings: np.ndarray


def pls_fit(xx: np.ndarray, xy: np.ndarray, components: int) -> Pls:
    """SIMPLS (de Jong 1993) from the centred cross-products X'X and X'Y."""
    rest = xy.copy()
    basis, weights, p_all, q_all = [], [], [], []
    scale = np.linalg.norm(xy)
    for _ in range(components):
        if np.linalg.norm(rest) <= 1e-12 * max(scale, 1e-300):
            break
        r = rest[:, 0] if rest.shape[1] == 1 else np.linalg.svd(rest, full_matrices=False)[0][:, 0]
        size = r @ xx @ r
        if size <= 0:
            break
        r = r / np.sqrt(size)
        p = xx @ r
        v = p.copy()
        for _twice in range(2):
            for u in basis:
                v -= u * (u @ v)
        length = np.linalg.norm(v)
        if length <= 1e-12 * np.linalg.norm(p):
            break
        v /= length
        basis.append(v)
        weights.append(r)
        p_all.append(p)
        q_all.append(xy.T @ r)
        rest = rest - np.outer(v, v @ rest)
    d, m = xy.shape
    w = np.column_stack(weights) if weights else np.zeros((d, 0))
    q = np.column_stack(q_all) if q_all else np.zeros((m, 0))
    p = np.column_stack(p_all) if p_all else np.zeros((d, 0))
    return Pls(w @ q.T, w, p, q)


@dataclass(frozen=True)
class LinearModel:
    """Class scores or a fitted value that are affine in the raw signal."""

    kind: str
    weights: np.ndarray
    intercept: np.ndarray

    def scores(self, x: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
        """(class index 0..K-1, score matrix)."""
        z = x @ self.weights + self.intercept
        if self.kind == "PCA-LDA":
            z = np.exp(z - z.max(axis=1, keepdims=True))
            prob = z / z.sum(axis=1, keepdims=True)
            return prob.argmax(axis=1), prob
        fit = z[:, 0]
        if self.kind == "PLS-PM1":
            low = 1.0 / (1.0 + np.exp(-fit))
            return (fit < 0).astype(int), np.column_stack([low, 1.0 - low])
        nearest = np.clip(np.sign(fit) * np.floor(np.abs(fit) + 0.5), 1, n_classes).astype(int) - 1
        close = np.exp(-np.abs(fit[:, None] - np.arange(1, n_classes + 1)))
        return nearest, close / close.sum(axis=1, keepdims=True)


def fit_linear(kind: str, recipe, parts: Mapping, classes: Sequence, config: Mapping) -> LinearModel:
    """Fit 'PCA-LDA', 'PLS-DA' or 'PLS-PM1' after a recipe, expressed on the raw signal.

    'PLS-DA' regresses the class number, 'PLS-PM1' +1 for the first of two
    classes and -1 for the other.

    ``parts`` holds the training statistics of the classes present, ``classes``
    the declared order; a class without training rows is never predicted.
    """
    present = [c for c in classes if c in parts]
    train = pooled([parts[c] for c in present])
    t, offset = recipe_map(recipe, train)
    mapped = {c: parts[c].mapped(t, offset) for c in present}
    if kind == "PCA-LDA":
        pca = pca_fit(pooled(list(mapped.values())), config["pca_variance_threshold"], config["pca_max_components"])
        c = pca.coeff.T
        priors = None
        if config.get("cost_penalty"):
            priors = weighted_priors({k: s.n for k, s in mapped.items()}, config["positive"], config["cost_penalty"])
        scores = {k: s.mapped(c, -c @ pca.mean) for k, s in mapped.items()}
        w, b = lda_weights(scores, priors, config["lda_gamma"], config["lda_delta"])
        weights = np.zeros((len(train.mean), len(classes)))
        intercept = np.full(len(classes), -np.inf)
        where = [classes.index(k) for k in present]
        weights[:, where] = t.T @ pca.coeff @ w
        intercept[where] = b + (c @ (offset - pca.mean)) @ w
        return LinearModel(kind, weights, intercept)
    if kind in ("PLS-DA", "PLS-PM1"):
        numbers = [classes.index(k) + 1 for k in present]
        if kind == "PLS-PM1":
            numbers = [1.0 if k == classes[0] else -1.0 for k in present]
        pls, mean_y = plsda_moments(mapped, config["pls_ncomp"], numbers)
        beta = pls.beta[:, 0]
        centre = pooled(list(mapped.values())).mean
        return LinearModel(kind, (t.T @ beta)[:, None], np.array([mean_y + (offset - centre) @ beta]))
    raise ValueError(f"not a linear classifier: {kind}")


def plsda_moments(parts: Mapping, components: int, targets: Sequence[float] | None = None) -> tuple[Pls, float]:
    """PLS of the class number (1..K, or ``targets``) on the signal."""
    stats = list(parts.values())
    y = np.arange(1, len(stats) + 1, dtype=float) if targets is None else np.asarray(targets, dtype=float)
    both = pooled(stats)
    mean_y = sum(s.n * v for s, v in zip(stats, y)) / both.n
    xy = sum(s.n * (v - mean_y) * (s.mean - both.mean) for s, v in zip(stats, y))
    limit = min(components, len(both.mean), both.n - 1)
    return pls_fit(both.scatter, xy[:, None], limit), mean_y



# 0.99 quantiles of the chi-squared distribution for 1..10 degrees of freedom.
CHI2_99 = (6.634897, 9.210340, 11.344867, 13.276704, 15.086272, 16.811894, 18.475307, 20.090235, 21.665994, 23.209251)
