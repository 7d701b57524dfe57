"""Gradient boosted trees with logistic loss and Platt calibration, in numpy.

Small on purpose: it fits a bounded training set on the driver (the bound is the
caller's parameter) and travels to the workers as a few arrays.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees over quantile bins; predict() gives calibrated probabilities."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.a, self.b = 0.0, 1.0, 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Every fifth row is kept from the trees and calibrates them."""
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        held = np.arange(len(y)) % 5 == 4
        binned, t = self._bin(x[~held]), y[~held].astype(float)
        rate = np.clip(t.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(t), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(binned, t - p, p * (1 - p))
        raw, t = self.margin(x[held]), y[held].astype(float)
        for _ in range(60):  # Newton steps on the two calibration weights
            p = 1 / (1 + np.exp(-(self.a * raw + self.b)))
            g = np.array([((p - t) * raw).sum(), (p - t).sum()]) + np.array([1e-2 * (self.a - 1), 1e-2 * self.b])
            w = p * (1 - p)
            h = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-2 * np.eye(2)
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            self.a, self.b = self.a - step[0], self.b - step[1]
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(g), int)
        width = self.bins + 1
        for node in range(size):
            own = at == node
            if not own.any():
                continue
            xs, gs, hs = x[own], g[own], h[own]
            value[node] = self.rate * gs.sum() / (hs.sum() + self.ridge)
            if node >= 2**self.depth - 1 or own.sum() < 8:
                continue
            best = 1e-6
            base = gs.sum() ** 2 / (hs.sum() + self.ridge)
            for j in range(x.shape[1]):
                gl = np.cumsum(np.bincount(xs[:, j], gs, width))[:-1]
                hl = np.cumsum(np.bincount(xs[:, j], hs, width))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + self.ridge) - base
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, k
            if feature[node] >= 0:
                right = x[:, feature[node]] > cut[node]
                at = np.where(own, 2 * node + 1 + right, at)
        self.trees.append((feature, cut, value))
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[at]
                at = np.where(j >= 0, 2 * at + 1 + (binned[rows, np.maximum(j, 0)] > cut[at]), at)
            f += value[at]
        return f

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.margin(x) + self.b)))
