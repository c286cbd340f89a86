"""Gradient-boosted trees for a binary label, on histograms of binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; complete trees of ``depth`` levels, so that a row finds its leaf by comparisons alone.
    Features of zeros and ones take a matrix product for their sums, the others histograms of ``bins`` quantiles.
    Splits are sought on a ``part`` of the rows, drawn anew for every tree; leaves take all rows."""

    def __init__(self, rounds: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, part: float = 0.4):
        self.part, self.rounds, self.depth, self.rate, self.bins, self.ridge = part, rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        flags = np.flatnonzero(((x == 0) | (x == 1)).all(axis=0))
        scaled = np.setdiff1d(np.arange(width), flags)
        edges = [np.zeros(1)] * width
        for j in scaled:
            edges[j] = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1]))
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        margin = np.full(n, self.bias)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.value = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, leaves))
        everything, rng = np.arange(n), np.random.default_rng(1)
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            pick = np.flatnonzero(rng.random(n) < self.part) if n > 1000 else everything
            weights, rows, own = (grad[pick], hess[pick]), np.arange(len(pick)), codes[pick]
            by_feature = np.ascontiguousarray(own[:, scaled].T).astype(np.int32)
            off = np.ascontiguousarray(own[:, flags].T == 0).astype(np.float32)  # a flag's lower side
            cut = np.full(inner, 255, np.uint8)
            at = np.zeros(len(pick), np.int64)  # of the tree's nodes in level order
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                node = (at - first).astype(np.int32)
                spread = np.zeros((len(pick), 2 * count), np.float32)
                lower = np.zeros((2, count, width, self.bins))  # sums of what lies at or below each edge
                for k, w in enumerate(weights):
                    spread[rows, k * count + node] = w
                    for j, code in zip(scaled, by_feature):
                        lower[k][:, j] = np.bincount(node * self.bins + code, w, count * self.bins).reshape(count, self.bins).cumsum(axis=1)
                    lower[k][:, flags, 1:] = np.bincount(node, w, count)[:, None, None]
                lower[:, :, flags, 0] = (off @ spread).T.reshape(2, count, len(flags))
                g, h = lower
                gs, hs = (np.bincount(node, w, count)[:, None, None] for w in weights)
                gain = g**2 / (h + self.ridge) + (gs - g) ** 2 / (np.maximum(0, hs - h) + self.ridge) - gs**2 / (hs + self.ridge)
                best = gain.reshape(count, -1).argmax(axis=1)
                for k in range(count):
                    j, b = divmod(int(best[k]), self.bins)
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        self.feature[r, first + k], self.value[r, first + k], cut[first + k] = j, edges[j][b], b
                at = 2 * at + 1 + (own[rows, self.feature[r, at]] > cut[at])
            at = np.zeros(n, np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (codes[everything, self.feature[r, at]] > cut[at])
            at -= inner
            g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
            self.leaf[r] = -self.rate * g / (h + self.ridge)
            margin += self.leaf[r, at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        out = np.full(len(x), self.bias)
        for feature, value, leaf in zip(self.feature, self.value, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > value[at])
            out += leaf[at - inner]
        return out
