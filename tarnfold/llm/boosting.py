"""Gradient-boosted trees for a binary target, fitted in numpy and evaluated as SQL expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Logistic loss, Newton leaves.  A tree is nested tuples (feature, limit, left, right) with numbers as leaves; left takes values <= limit."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.4, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.smooth = rounds, depth, rate, smooth
        self.trees: list = []
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            score += _evaluate(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(round(self.rate * g.sum() / (h.sum() + self.smooth), 6))
        best = (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + self.smooth)
        for f in range(x.shape[1]) if depth else ():
            for limit in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= limit
                a, b = g[left].sum(), h[left].sum()
                gain = a * a / (b + self.smooth) + (g.sum() - a) ** 2 / (h.sum() - b + self.smooth) - whole
                if gain > best[0]:
                    best = (gain, f, float(limit))
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(_evaluate(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> BoostedTrees:
        """Platt's logistic curve on rows that were not fitted; the threshold is the least probability with at least this precision from there on."""
        s = self.raw(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(self.slope * s + self.shift)))
            w = p * (1 - p) + 1e-9
            d = np.array([((y - p) * s).sum(), (y - p).sum()])
            m = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            self.slope, self.shift = (np.array([self.slope, self.shift]) + np.clip(np.linalg.solve(m, d), -1, 1)).tolist()
        p = self.probability(x)
        order = np.argsort(-p)
        good = np.flatnonzero(np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision)
        self.threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 1.0
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability as an expression."""

        def tree(t) -> Column:
            return F.lit(t) if not isinstance(t, tuple) else F.when(features[t[0]] <= F.lit(t[1]), tree(t[2])).otherwise(tree(t[3]))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + tree(t)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))


def _evaluate(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, limit, left, right = tree
    return np.where(x[:, f] <= limit, _evaluate(left, x), _evaluate(right, x))
