"""Gradient-boosted trees of fixed depth for the logistic loss, on histogram bins. Small enough to travel inside a task closure."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, p = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(p)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(p)], 1)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(n, self.base)
        width = self.bins + 1
        for t in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            for d in range(self.depth):
                first, count = 2**d - 1, 2**d
                local = node - first
                best_gain, best = np.full(count, 1e-6), [(0, np.inf)] * count
                for j in range(p):
                    slot = local * width + binned[:, j]
                    g = np.bincount(slot, grad, count * width).reshape(count, width).cumsum(1)
                    h = np.bincount(slot, hess, count * width).reshape(count, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                    gain = gain[:, : len(edges[j])]
                    if not gain.shape[1]:
                        continue
                    k = gain.argmax(1)
                    for c in range(count):
                        if gain[c, k[c]] > best_gain[c]:
                            best_gain[c], best[c] = gain[c, k[c]], (j, edges[j][k[c]])
                for c, (j, cut) in enumerate(best):
                    self.feature[t, first + c], self.cut[t, first + c] = j, cut
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
            self.value[t] = self.rate * g / (h + self.ridge)
            score += self.value[t, leaf]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            score += self.value[t, node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
