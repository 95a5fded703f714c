"""Gradient-boosted regression trees for a yes/no label, on binned features (small training sets)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth over quantile bins; deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._walk(tree, binned)
        return score

    def _bin(self, x):
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.uint8)

    def _grow(self, binned, gradient, curvature):
        """Arrays over a complete binary tree: feature (-1: leaf), bin, value."""
        size = 2 ** (self.depth + 1) - 1
        feature, at, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        members = {0: np.arange(len(gradient))}
        width = self.bins + 1
        for node in range(size):
            rows = members.pop(node, None)
            if rows is None or not len(rows):
                continue
            g, h = gradient[rows].sum(), curvature[rows].sum()
            value[node] = -self.rate * g / (h + 1.0)
            if 2 * node + 2 >= size:
                continue
            best, cut = 1e-6, None
            for j in range(binned.shape[1]):
                left_g = np.cumsum(np.bincount(binned[rows, j], gradient[rows], width))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, j], curvature[rows], width))[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                gain[(left_h < self.least) | (h - left_h < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, cut = gain[k], (j, k)
            if cut:
                feature[node], at[node] = cut
                low = binned[rows, cut[0]] <= cut[1]
                members[2 * node + 1], members[2 * node + 2] = rows[low], rows[~low]
        return feature, at, value

    def _walk(self, tree, binned):
        feature, at, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            inner = feature[node] >= 0
            right = binned[rows, np.maximum(feature[node], 0)] > at[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]
