"""Gradient-boosted regression trees on binned features, for samples that fit one process."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Least-squares boosting of small trees; thresholds are quantiles of the training data."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.12, bins: int = 32, min_leaf: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.min_leaf = rounds, depth, rate, bins, min_leaf
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).astype(np.int64) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
        binned = self._bin(x)
        n, width = binned.shape
        self.base = float(y.mean())
        guess = np.full(n, self.base)
        span = self.bins
        spread, rows = binned + np.arange(width) * span, np.arange(n)
        first_flat = spread.ravel()
        first_size = np.bincount(first_flat, minlength=width * span).reshape(1, width, span).astype(float)
        for _ in range(self.rounds):
            rest = y - guess
            nodes = 2**self.depth
            feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, span, np.int64), np.zeros(nodes)
            where = np.ones(n, np.int64)
            weights = np.repeat(rest, width)
            for level in range(self.depth):
                first, many = 2**level, 2**level
                flat = (((where - first) * (width * span))[:, None] + spread).ravel() if level else first_flat
                size = np.bincount(flat, minlength=many * width * span).reshape(many, width, span).astype(float) if level else first_size
                total = np.bincount(flat, weights=weights, minlength=many * width * span).reshape(many, width, span)
                all_n, all_s = size[:, :1].sum(axis=2, keepdims=True), total[:, :1].sum(axis=2, keepdims=True)
                size, total = size.cumsum(2)[:, :, :-1], total.cumsum(2)[:, :, :-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = total**2 / size + (all_s - total) ** 2 / (all_n - size) - all_s**2 / all_n
                gain[~((size >= self.min_leaf) & (all_n - size >= self.min_leaf))] = -1
                gain = gain.reshape(many, -1)
                best = gain.argmax(axis=1)
                good = gain[np.arange(many), best] > 1e-12
                feature[first : first + many] = np.where(good, best // (span - 1), 0)
                cut[first : first + many] = np.where(good, best % (span - 1), span)
                where = 2 * where + (binned[rows, feature[where]] > cut[where])
            leaf = where - nodes
            counts = np.bincount(leaf, minlength=nodes)
            value = np.bincount(leaf, weights=rest, minlength=nodes) / np.maximum(counts, 1) * self.rate
            self.trees.append((feature, cut, value))
            guess += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                where = 2 * where + (binned[rows, feature[where]] > cut[where])
            out += value[where - 2**self.depth]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration by pooling adjacent violators: knots (x, y) for linear interpolation."""
    order = np.argsort(x, kind="stable")
    level: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        level.append([b, 1.0, a])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v, n, s = level.pop()
            u, m, t = level.pop()
            level.append([(u * m + v * n) / (m + n), m + n, (t * m + s * n) / (m + n)])
    return np.array([v[2] for v in level]), np.array([v[0] for v in level])
