"""A small random forest for two classes, in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, trees: int = 25, depth: int = 7, least: int = 4, seed: int = 0):
        self.trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)
        self.roots: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        for _ in range(self.trees):
            rows = self.rng.integers(0, len(x), len(x))
            self.roots.append(self._grow(x[rows], y[rows], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if not depth or len(y) < 2 * self.least or share in (0.0, 1.0):
            return share
        best = (2.0, 0, 0.0)
        for f in self.rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[:-1] < v[1:])
            cut = cut[(cut + 1 >= self.least) & (len(y) - cut - 1 >= self.least)]
            if not cut.size:
                continue
            left, n = cut + 1, len(y)
            p, q = ones[cut] / left, (ones[-1] - ones[cut]) / (n - left)
            gini = (left * p * (1 - p) + (n - left) * q * (1 - q)) / n
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (float(gini[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[0] == 2.0:
            return share
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of the first class in the leaves that each row reaches."""
        total = np.zeros(len(x))

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, float):
                total[rows] += node
            elif len(rows):
                low = x[rows, node[0]] <= node[1]
                walk(node[2], rows[low])
                walk(node[3], rows[~low])

        for root in self.roots:
            walk(root, np.arange(len(x)))
        return total / max(1, len(self.roots))
