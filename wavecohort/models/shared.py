"""Kernel machines and forests fitted on a matrix of rows, many settings at a time.

Cross-validation and grid search need hundreds of these fits on the same rows.
A fit here takes a matrix that fits into one task and shares its work: all
penalties of a kernel scale use one set of random features, and forests of fewer
trees or a smaller depth are parts of one forest, because a tree grown to depth
5 is the top of the same tree grown to 30.  Beside the matrix a fit holds little:
random features are mapped in blocks of rows, and a forest can be scored while
it grows, a few trees at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np

BINS = 32
CELLS = 400_000  # rows x trees that grow together
MAPPED = 16_384  # rows that are mapped to random features at a time
HELD = 2 * MAPPED  # rows whose random features are kept from pass to pass


class KernelMachine:
    """Random Fourier features and linear machines with squared hinge loss, one for each penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: float | str, penalties: Sequence[float], n: int, seed: int):
        """``y`` is -1 or 1; ``weight`` multiplies the loss of each row."""
        if scale == "auto":
            total = float(x.var(axis=0, ddof=1).sum()) if len(x) > 1 else 0.0
            scale = np.sqrt(2.0 * total) if total > 0 else 1.0
        rng = np.random.default_rng(seed)
        self.omega, self.phase = rng.normal(0.0, np.sqrt(2.0) / scale, (x.shape[1], n)), rng.uniform(0.0, 2 * np.pi, n)
        mapped = lambda: ((slice(i, i + MAPPED), self._map(x[i:i + MAPPED])) for i in range(0, len(x), MAPPED))
        kept = list(mapped()) if len(x) <= HELD else None
        self.weights = np.stack([minimise((lambda: kept) if kept else mapped, y, c * weight, n + 1) for c in penalties], axis=1)

    def _map(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.column_stack([z, np.ones(len(x))])

    def decision(self, x: np.ndarray) -> np.ndarray:
        """(rows, penalties)."""
        return self._map(x) @ self.weights


def _hinge(f, y, c) -> float:
    return float(c @ np.maximum(0.0, 1.0 - y * f) ** 2)


def _pull(z, y, c, f) -> np.ndarray:
    return -2.0 * z.T @ (c * y * np.maximum(0.0, 1.0 - y * f))


def loss(z, y, c, w) -> float:
    return 0.5 * float(w[:-1] @ w[:-1]) + _hinge(z @ w, y, c)


def slope(z, y, c, w) -> np.ndarray:
    return np.append(w[:-1], 0.0) + _pull(z, y, c, z @ w)


def minimise(blocks: Callable[[], Iterator[tuple[slice, np.ndarray]]], y: np.ndarray, c: np.ndarray, width: int, steps: int = 50) -> np.ndarray:
    """Least :func:`loss` over all rows by Newton steps; the last column of ``z`` is the free intercept.

    ``blocks`` gives (rows, their part of ``z``) and is called twice a step; sums
    over the blocks and one value a row are all that is kept.
    """
    w, f = np.zeros(width), np.zeros(len(y))  # f is z w
    ridge = np.append(np.ones(width - 1), 1e-9)
    for _ in range(steps):
        g, h = np.append(w[:-1], 0.0), np.diag(ridge)
        for at, z in blocks():
            g += _pull(z, y[at], c[at], f[at])
            live = y[at] * f[at] < 1
            near = z[live]
            h += 2.0 * (near.T * c[at][live]) @ near
        if np.abs(g).max() < 1e-8 * max(1.0, float(c.sum())):
            break
        step = np.linalg.solve(h, -g)
        along = np.concatenate([z @ step for _, z in blocks()])
        at_size = lambda size: 0.5 * float(np.sum((w + size * step)[:-1] ** 2)) + _hinge(f + size * along, y, c)
        size, now = 1.0, at_size(0.0)
        while size > 1e-6 and at_size(size) > now + 1e-4 * size * float(g @ step):
            size /= 2
        w, f = w + size * step, f + size * along
    return w


class Forest:
    """Bagged trees on binned features with sqrt(d) candidates for every split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, class_weight: np.ndarray, trees: int, depth: int, leaf: int, seed: int):
        """``y`` is 0 to k - 1; all nodes of a level of many trees are split together."""
        parts = list(Forest.parts(x, y, k, class_weight, trees, depth, leaf, seed))
        upto = np.cumsum([0, *[len(p.feature) for p in parts]])
        self.cuts, self.depth, self.trees = parts[0].cuts, depth, trees
        self.feature = np.concatenate([p.feature for p in parts])
        self.cut = np.concatenate([p.cut for p in parts])
        self.left = np.concatenate([np.where(p.left >= 0, p.left + upto[i], -1) for i, p in enumerate(parts)])
        self.share = np.concatenate([p.share for p in parts])
        self.root = np.concatenate([p.root + upto[i] for i, p in enumerate(parts)])

    @classmethod
    def parts(cls, x: np.ndarray, y: np.ndarray, k: int, class_weight: np.ndarray, trees: int, depth: int, leaf: int, seed: int) -> Iterator[Forest]:
        """The same trees as forests of a few trees each, one after another."""
        cuts = np.stack([np.quantile(column, np.arange(1, BINS) / BINS) for column in x.T])
        binned = _bin(x, cuts)
        del x  # bytes are enough from here on
        rng = np.random.default_rng(seed)
        step = max(1, CELLS // max(1, len(binned)))
        for t in range(0, trees, step):
            part = object.__new__(cls)
            part.cuts, part.depth, part.trees = cuts, depth, min(step, trees - t)
            part.feature, part.cut, part.left, part.share = part._grow(binned, y, k, class_weight, part.trees, leaf, rng)
            part.root = np.arange(part.trees)
            yield part

    def _grow(self, binned, y, k, class_weight, trees, leaf, rng):
        n, d = binned.shape
        tries, flat = max(1, int(np.sqrt(d))), binned.ravel()
        row = rng.integers(0, n, (trees, n)).ravel()
        node = np.repeat(np.arange(trees), n)
        feature, cut, left, share = [], [], [], []
        made, m = trees, trees
        for level in range(self.depth + 1):
            counts = np.bincount(node * k + y[row], minlength=m * k).reshape(m, k)
            weighted = counts * class_weight
            share.append(weighted / np.maximum(weighted.sum(1, keepdims=True), 1e-300))
            feature.append(np.zeros(m, np.int32))
            cut.append(np.zeros(m, np.uint8))
            left.append(np.full(m, -1, np.int64))
            wide = (counts.sum(1) >= 2 * leaf) & (counts.max(1) < counts.sum(1))
            if level == self.depth or not wide.any():
                break
            place = np.cumsum(wide) - 1
            keep = wide[node]
            row, node = row[keep], place[node[keep]]
            m = int(wide.sum())
            tried = np.argpartition(rng.random((m, d)), tries - 1, axis=1)[:, :tries]
            total, all_ = counts[wide], weighted[wide]
            best = (all_**2).sum(1) / all_.sum(1) + 1e-9
            where, by = np.full(m, -1), np.zeros(m, np.int32)
            at_row, cell = row * d, (y[row] * m + node) * BINS
            for j in range(tries):
                f = np.ascontiguousarray(tried[:, j])
                hist = np.bincount(cell + flat[at_row + f[node]], minlength=k * m * BINS).reshape(k, m, BINS)
                value, at = _best_cut(hist, total, class_weight, leaf)
                better = value > best
                best, where, by = np.where(better, value, best), np.where(better, at, where), np.where(better, f, by)
            split = where >= 0
            if not split.any():
                break
            owner = np.flatnonzero(wide)[split]
            feature[-1][owner], cut[-1][owner] = by[split], where[split]
            left[-1][owner] = made + 2 * np.arange(len(owner))
            keep = split[node]
            row, node = row[keep], node[keep]
            right = binned[row, by[node]] > where[node]
            node = 2 * (np.cumsum(split) - 1)[node] + right
            m = 2 * len(owner)
            made += m
        return np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(share)

    def scores(self, x: np.ndarray, points: Sequence[tuple[int, int]]) -> list[np.ndarray]:
        """Mean class shares of the first ``trees`` trees down to ``depth``, for each (trees, depth)."""
        return mean_shares([self], x, points)

    def _add(self, binned: np.ndarray, sums: dict[tuple[int, int], np.ndarray], before: int) -> None:
        """Add the class shares of every tree to the points that have it; ``before`` trees of the forest came in other parts."""
        n, d = binned.shape
        flat = binned.ravel()
        for t, root in enumerate(self.root, before):
            node = np.full(n, root)
            moving, here = np.arange(n), node.copy()  # rows that are not in a leaf yet
            for level in range(self.depth + 1):
                for p in sums:
                    if t < p[0] and level == min(p[1], self.depth):
                        sums[p] += self.share[node]
                down = self.left[here]
                inner = down >= 0
                if not inner.any():
                    for p in sums:
                        if t < p[0] and level < min(p[1], self.depth):
                            sums[p] += self.share[node]
                    break
                moving, here, down = moving[inner], here[inner], down[inner]
                here = down + (flat[moving * d + self.feature[here]] > self.cut[here])
                node[moving] = here


def mean_shares(parts: Iterable[Forest], x: np.ndarray, points: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """:meth:`Forest.scores` of a forest in parts, each of which can go when it has been added."""
    binned, sums, trees = None, {}, 0
    for part in parts:
        if binned is None:
            binned, sums = _bin(x, part.cuts), {p: np.zeros((len(x), part.share.shape[1])) for p in points}
        part._add(binned, sums, trees)
        trees += part.trees
    return [sums[p] / min(p[0], trees) for p in points]


def _bin(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], "left")
    return out


def _best_cut(hist: np.ndarray, total: np.ndarray, class_weight: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, bin) of every node's best cut; ``hist`` is classes x nodes x bins, one class at a time is in hand."""
    n_low = n_high = low_weight = high_weight = low_square = high_square = 0
    for c, w in enumerate(class_weight):
        low = np.cumsum(hist[c], axis=1)[:, :-1]
        high = total[:, c, None] - low
        a, z = low * w, high * w
        n_low, n_high, low_weight, high_weight = n_low + low, n_high + high, low_weight + a, high_weight + z
        low_square, high_square = low_square + a * a, high_square + z * z
    ok = (n_low >= leaf) & (n_high >= leaf)
    gain = np.where(ok, low_square / np.maximum(low_weight, 1e-300) + high_square / np.maximum(high_weight, 1e-300), -1.0)
    at = gain.argmax(1)
    return gain[np.arange(len(gain)), at], at
