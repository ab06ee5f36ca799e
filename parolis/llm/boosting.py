"""Gradient-boosted trees on numpy: logistic loss, histogram splits, oblivious of row order."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Binary classifier. Trees are complete and stored as flat arrays, so that scoring is a few gathers a level."""

    rounds: int = 80
    depth: int = 5
    rate: float = 0.2
    bins: int = 24
    l2: float = 1.0
    #: Least curvature of the loss on either side of a split.
    least: float = 1.5
    edges: list = field(default_factory=list)
    feature: np.ndarray | None = None
    cut: np.ndarray | None = None
    leaf: np.ndarray | None = None
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        nodes, leaves, width = 2**self.depth - 1, 2**self.depth, self.bins + 1
        self.feature = np.zeros((self.rounds, nodes), dtype=np.int32)
        self.cut = np.full((self.rounds, nodes), np.inf)
        self.leaf = np.zeros((self.rounds, leaves))
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        score = np.full(n, self.bias)
        for r in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            at = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best_gain, best_f, best_c = np.full(count, 1e-6), np.zeros(count, int), np.full(count, -1)
                for j in range(f):
                    key = (at - first) * width + codes[:, j]
                    g, h = (np.bincount(key, weights=w, minlength=count * width).reshape(count, width).cumsum(axis=1) for w in (grad, hess))
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt**2 / (ht + self.l2)
                    gain[(h < self.least) | (ht - h < self.least)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(count), k]
                    better = top > best_gain
                    best_gain[better], best_f[better], best_c[better] = top[better], j, k[better]
                for m in range(count):
                    if best_c[m] >= 0 and best_c[m] < len(self.edges[best_f[m]]):
                        self.feature[r, first + m] = best_f[m]
                        self.cut[r, first + m] = self.edges[best_f[m]][best_c[m]]
                go = x[np.arange(n), self.feature[r, at]] > self.cut[r, at]
                at = 2 * at + 1 + go
            k = at - nodes
            g, h = np.bincount(k, weights=grad, minlength=leaves), np.bincount(k, weights=hess, minlength=leaves)
            self.leaf[r] = self.rate * g / (h + self.l2)
            score += self.leaf[r, k]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        nodes = 2**self.depth - 1
        for r in range(self.rounds):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[r, at]] > self.cut[r, at])
            out += self.leaf[r, at - nodes]
        return out


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that calibrate margins to probabilities (Newton steps on the logistic loss)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * margin).sum() + 1e-2 * (a - 1), (p - y).sum()])
        h = np.array([[(w * margin**2).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - float(d[0]), b - float(d[1])
        if np.abs(d).max() < 1e-6:
            break
    return a, b
