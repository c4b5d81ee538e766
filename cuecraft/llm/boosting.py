"""Gradient-boosted trees for two classes, on histograms, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth: a feature and a bound for each inner node, a value for each leaf."""

    def __init__(self, base: float, features: np.ndarray, bounds: np.ndarray, values: np.ndarray):
        self.base, self.features, self.bounds, self.values = base, features, bounds, values

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        depth = self.values.shape[1].bit_length() - 1
        for feature, bound, value in zip(self.features, self.bounds, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += value[at - (len(value) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Trees:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(len(y), np.log(share / (1 - share)))
    out = Trees(float(margin[0]) if len(margin) else 0.0, *(np.zeros((trees, n), t) for n, t in ((2**depth - 1, np.int64), (2**depth - 1, float), (2**depth, float))))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            n, base = 2**level, 2**level - 1
            best = np.full(n, 1e-6)
            local = at - base
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                width = len(cut) + 1
                key = local * width + binned[:, f]
                g, h, c = (np.cumsum(np.bincount(key, w, n * width).reshape(n, width), axis=1) for w in (grad, hess, None))
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c < least) | (c[:, -1:] - c < least)] = 0
                pick = gain[:, :-1].argmax(1)
                value = gain[np.arange(n), pick]
                better = value > best
                best[better] = value[better]
                out.features[t, base : base + n][better] = f
                out.bounds[t, base : base + n][better] = cut[pick[better]]
            stuck = best <= 1e-6
            out.bounds[t, base : base + n][stuck] = np.inf
            at = 2 * at + 1 + (x[np.arange(len(x)), out.features[t, at]] > out.bounds[t, at])
        leaf = at - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        out.values[t] = rate * g / (h + ridge)
        margin += out.values[t][leaf]
    return out
