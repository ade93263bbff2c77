"""Gradient-boosted trees on numpy, for small bounded training samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees over quantile-binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, q * (1 - q) + 1e-6
            nodes = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
            at = np.zeros(len(y), dtype=np.int64)
            for n in range(2**self.depth - 1):
                rows = np.flatnonzero(at == n)
                cut = self._best(b[rows], grad[rows], hess[rows]) if len(rows) > 20 else None
                if cut is None:
                    nodes[n] = (-1, 0, float(grad[rows].sum() / (hess[rows].sum() + 1.0)) if len(rows) else 0.0)
                    continue
                nodes[n] = (cut[0], cut[1], 0.0)
                at[rows] = 2 * n + 1 + (b[rows, cut[0]] > cut[1])
            for n in range(2**self.depth - 1, len(nodes)):
                rows = at == n
                if rows.any():
                    nodes[n] = (-1, 0, float(grad[rows].sum() / (hess[rows].sum() + 1.0)))
            self.trees.append(nodes)
            score += self.rate * self._walk(b, nodes)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def _best(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        best, where = 1e-6, None
        g, h = grad.sum(), hess.sum()
        for f in range(b.shape[1]):
            gl = np.bincount(b[:, f], grad, self.bins + 1).cumsum()[:-1]
            hl = np.bincount(b[:, f], hess, self.bins + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = float(gain[k]), (f, k)
        return where

    def _walk(self, b: np.ndarray, nodes: list) -> np.ndarray:
        feature, cut, value = (np.array(v) for v in zip(*nodes))
        at = np.zeros(len(b), dtype=np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            step = 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at])
            at = np.where(inner, step, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(np.asarray(x, dtype=float))
        score = np.full(len(b), self.base)
        for t in self.trees:
            score += self.rate * self._walk(b, t)
        return 1 / (1 + np.exp(-score))
