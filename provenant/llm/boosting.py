"""Gradient-boosted trees for a binary label, small enough to fit on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.prior, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else []
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else x
        margin = np.full(len(x), self.prior)
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree, at = {}, np.zeros(len(x), np.int64)
            self._split(tree, 0, 0, np.arange(len(x)), bins, edges, y - p, p * (1 - p), at)
            values = np.array([tree[k][2] if k in tree else 0.0 for k in range(2 ** (self.depth + 1))])
            margin += values[at]
            self.trees.append(tree)
        return self

    def _split(self, tree, node, level, rows, bins, edges, slope, curve, at) -> None:
        g, h = slope[rows].sum(), curve[rows].sum()
        at[rows] = node
        tree[node] = (-1, 0.0, self.rate * g / (h + self.ridge))
        if level == self.depth or len(rows) < 20:
            return
        best = (1e-6, None, None)
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gs = np.cumsum(np.bincount(b, slope[rows], BINS + 1))[:-1]
            hs = np.cumsum(np.bincount(b, curve[rows], BINS + 1))[:-1]
            gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
            gain[(hs < 1e-3) | (h - hs < 1e-3)] = 0
            gain = gain[: len(edges[f])]
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        _, f, cut = best
        if f is None:
            return
        left = bins[rows, f] <= cut
        tree[node] = (f, float(edges[f][cut]), tree[node][2])
        self._split(tree, 2 * node + 1, level + 1, rows[left], bins, edges, slope, curve, at)
        self._split(tree, 2 * node + 2, level + 1, rows[~left], bins, edges, slope, curve, at)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the label."""
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                f, cut, value = tree[node]
                if f < 0:
                    out[rows] += value
                    continue
                left = x[rows, f] <= cut
                todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        return out
