"""Histogram gradient-boosted trees in numpy: fitted on a bounded sample, scored from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in level order. Node k's children are 2k+1 (x <= threshold) and 2k+2; a node that
    isn't split has threshold +inf, so every row walks the same number of levels."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values (log odds) of every row, walking one level of one tree for all rows at a time."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: float = 3.0,
    monotone: np.ndarray | None = None,
) -> Trees:
    """Boost logistic loss. least: hessian a child needs. monotone: per feature -1, 0 or +1; the score then never
    rises (falls) with that feature, since a split's sides keep their order and bound all that is below them.
    With no rows, or one class, the model is a constant."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    n, d = x.shape
    monotone = np.zeros(d, np.int64) if monotone is None else monotone
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # x <= cuts[k] exactly when bin <= k
    usable = np.stack([np.arange(bins) < len(c) for c in cuts])
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            width = 2**level
            sums = np.empty((2, d, width, bins))
            for j in range(d):
                cell = node * bins + binned[j]
                sums[0, j] = np.bincount(cell, g, width * bins).reshape(width, bins)
                sums[1, j] = np.bincount(cell, h, width * bins).reshape(width, bins)
            left = np.cumsum(sums, axis=3)
            right = left[..., -1:] - left
            bound = lambda v: np.clip(v, low[None, :, None], high[None, :, None])  # noqa: B023, E731
            lv, rv = bound(-left[0] / (left[1] + ridge)), bound(-right[0] / (right[1] + ridge))
            all_g, all_h = left[0, ..., -1:], left[1, ..., -1:]
            own = bound(-all_g / (all_h + ridge))
            worth = lambda s, v: -(s[0] * v + 0.5 * (s[1] + ridge) * v * v)
            gain = worth(left, lv) + worth(right, rv) - worth((all_g, all_h), own)
            allowed = usable[:, None, :] & (left[1] >= least) & (right[1] >= least) & (monotone[:, None, None] * (rv - lv) >= 0)
            gain = np.where(allowed, gain, 0).transpose(1, 0, 2).reshape(width, -1)
            best = gain.argmax(1)
            split = gain[np.arange(width), best] > 1e-6
            j, k = best // bins, best % bins
            at = width - 1 + np.arange(width)
            feature[t, at] = np.where(split, j, 0)
            threshold[t, at] = [cuts[a][c] if s else np.inf for a, c, s in zip(j, k, split, strict=True)]
            a, c = lv[j, np.arange(width), k], rv[j, np.arange(width), k]
            middle, way = (a + c) / 2, np.where(split, monotone[j], 0)
            low = np.stack((np.where(way < 0, middle, low), np.where(way > 0, middle, low)), 1).reshape(-1)
            high = np.stack((np.where(way > 0, middle, high), np.where(way < 0, middle, high)), 1).reshape(-1)
            node = 2 * node + (split[node] & (binned[j[node], np.arange(n)] > k[node]))
        value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        leaf[t] = rate * np.clip(value, low, high)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)
