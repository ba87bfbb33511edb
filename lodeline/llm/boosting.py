"""Gradient-boosted trees on dense features and isotonic calibration, in numpy.

The training rows are a bounded sample (a parameter of the caller), so this runs on the driver; scoring is
vectorised and runs on executors.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, min_rows: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.min_rows = rounds, depth, rate, bins, ridge, min_rows
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Midpoints between values that occur keep both sides of a cut apart.
        self.edges = []
        for k in range(d):
            values = np.unique(x[:, k])
            mids = (values[1:] + values[:-1]) / 2
            self.edges.append(np.unique(np.quantile(mids, cuts, method="nearest")) if len(mids) > self.bins - 1 else mids)
        binned = self._bin(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, q * (1 - q)
            tree, leaf = self._grow(binned, grad, hess)
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """A complete tree of (feature, bin threshold) per inner node and a value per leaf; a node that isn't split sends all rows left."""
        n, d = binned.shape
        nodes = (1 << self.depth) - 1
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, self.bins + 1, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            for k in range(d):
                cells = (at * self.bins) + np.minimum(binned[:, k], self.bins - 1)
                g, h, c = (np.bincount(cells, w, width * self.bins).reshape(width, self.bins).cumsum(1) for w in (grad, hess, None))
                tg, th, tc = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + self.ridge) + (tg - g) ** 2 / (th - h + self.ridge) - tg**2 / (th + self.ridge)
                gain[(c < self.min_rows) | (tc - c < self.min_rows)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width] = np.where(better, k, feature[first : first + width])
                threshold[first : first + width] = np.where(better, top, threshold[first : first + width])
            node = first + at
            at = at * 2 + (binned[np.arange(n), feature[node]] > threshold[node])
        leaves = 1 << self.depth
        value = self.rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + self.ridge)
        return (feature, threshold, value), at

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = at * 2 + (binned[rows, feature[node]] > threshold[node])
            score += value[at]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (score, probability) to interpolate between, both ascending."""
    order = np.argsort(score, kind="stable")
    s, inverse = np.unique(score[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y[order].astype(float)) / weight
    blocks: list[list[float]] = []  # sum of weights, sum of values, first and last score
    for m, w, x in zip(mean, weight, s, strict=True):
        blocks.append([w, m * w, x, x])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ys = np.array([b[1] / b[0] for b in blocks for _ in (0, 1)])
    return xs, ys


class Calibrated:
    """Trees fitted on three quarters of the rows, calibrated on the rest; ties keep the trees' order."""

    def __init__(self, **options):
        self.trees = Boosted(**options)
        self.xs = self.ys = np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Calibrated:
        rest = np.arange(len(y)) % 4 == 3
        self.trees.fit(x[~rest], y[~rest])
        self.xs, self.ys = isotonic(self.trees.raw(x[rest]), y[rest])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        sure = 1 / (1 + np.exp(-raw))
        return 0.98 * np.interp(raw, self.xs, self.ys) + 0.02 * sure
