"""Gradient-boosted trees on dense features with isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Binary log-loss boosting of small trees over quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.made = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(self.edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.made.append(tree)
            margin += self._apply(tree, x)
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list[tuple]:
        """Nodes (feature, threshold, left, right, value), the first being the root; feature -1 is a leaf."""
        nodes: list = []

        def leaf(rows):
            return (-1, 0.0, 0, 0, -self.rate * grad[rows].sum() / (hess[rows].sum() + self.ridge))

        def add(rows, depth):
            at = len(nodes)
            nodes.append(leaf(rows))
            best = (1e-6, -1, 0)
            if depth < self.depth and len(rows) >= 2 * self.least:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + self.ridge)
                for f, edges in enumerate(self.edges):
                    if not len(edges):
                        continue
                    b = binned[rows, f]
                    gs = np.cumsum(np.bincount(b, g, len(edges) + 1))[:-1]
                    hs = np.cumsum(np.bincount(b, h, len(edges) + 1))[:-1]
                    n = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
                    gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - whole
                    gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] >= 0:
                _, f, k = best
                left = binned[rows, f] <= k
                nodes[at] = (f, float(self.edges[f][k]), add(rows[left], depth + 1), add(rows[~left], depth + 1), 0.0)
            return at

        add(np.arange(len(grad)), 0)
        return nodes

    @staticmethod
    def _apply(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        feature = np.array([n[0] for n in tree])
        limit = np.array([n[1] for n in tree])
        left, right, value = np.array([n[2] for n in tree]), np.array([n[3] for n in tree]), np.array([n[4] for n in tree])
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return value[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.made), np.zeros(len(x)))


class Isotonic:
    """The non-decreasing step function nearest to the labels (pool adjacent violators), kept off 0 and 1."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, greatest score
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][2] == blocks[-1][2]):
                top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], top[2]]
        self.at = np.array([b[2] for b in blocks])
        self.value = np.array([(b[0] + 0.1) / (b[1] + 0.2) for b in blocks])
        self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        step = self.value[np.minimum(np.searchsorted(self.at, score, side="left"), len(self.at) - 1)]
        # a small slope keeps scores apart within a step
        return np.clip(step + 1e-4 * np.tanh(score / 10), 0.0, 1.0)


class Calibrated:
    """Trees whose calibration is learnt on folds that they were not fitted on."""

    def __init__(self, folds: int = 4, **trees):
        self.folds, self.options = folds, trees

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray | None = None, seen: list[np.ndarray] | None = None) -> Calibrated:
        """``fold`` deals the rows; ``seen[k]`` are the rows' features as learnt without fold k, where features are learnt too."""
        self.trees = None
        self.constant = float(y.mean()) if len(y) else 0.5
        if len(y) < 20 or y.min() == y.max():
            return self
        out, fold = np.zeros(len(y)), np.arange(len(y)) % self.folds if fold is None else fold
        for k in range(self.folds):
            part, z = fold != k, x if seen is None else seen[k]
            out[~part] = Trees(**self.options).fit(z[part], y[part]).margin(z[~part])
        self.isotonic = Isotonic().fit(out, y)
        self.trees = Trees(**self.options).fit(x, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return self.isotonic(self.trees.margin(x))
