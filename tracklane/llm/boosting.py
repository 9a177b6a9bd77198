"""Gradient-boosted trees for two classes and isotonic calibration, in NumPy."""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """Log-loss boosting of level-wise trees of fixed depth over binned features.

    feature, cut: (trees, 2**depth - 1), nodes in heap order; leaf: (trees, 2**depth).
    """

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.start, self.feature, self.cut, self.leaf = start, feature, cut, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, l2: float = 5.0, least: float = 1.0) -> Trees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = (y.sum() + 1) / (n + 2)
        start = float(np.log(share / (1 - share)))
        margin = np.full(n, start)
        inner = 2**depth - 1
        feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width = 2**level
                best = np.full(width, 1e-9)
                where = [(0, np.inf, BINS)] * width
                for j in range(d):
                    cell = node * BINS + binned[:, j]
                    sg = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    sh = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                    gain[(sh < least) | (th - sh < least)] = 0
                    at = gain.argmax(axis=1)
                    for k in range(width):
                        if gain[k, at[k]] > best[k] and at[k] < len(edges[j]):
                            best[k] = gain[k, at[k]]
                            where[k] = (j, edges[j][at[k]], at[k])
                first = width - 1
                split = np.array([w[0] for w in where]), np.array([w[2] for w in where])
                feature[t, first : first + width] = split[0]
                cut[t, first : first + width] = [w[1] for w in where]
                node = 2 * node + (binned[np.arange(n), split[0][node]] > split[1][node])
            leaf[t] = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + l2)
            margin += leaf[t][node]
        return cls(start, feature, cut, leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising step function of y in scores (pool adjacent violators), to be interpolated."""
    order = np.argsort(scores, kind="stable")
    at, inverse = np.unique(scores[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    total = np.bincount(inverse, y[order])
    pools: list[list[float]] = []  # weight, total, first, last
    for x, w, s in zip(at.tolist(), weight.tolist(), total.tolist(), strict=True):
        pools.append([w, s, x, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, s2, _, last = pools.pop()
            pools[-1][0] += w2
            pools[-1][1] += s2
            pools[-1][3] = last
    knots = np.array([k for p in pools for k in ((p[2], p[1] / p[0]), (p[3], p[1] / p[0]))] or [(0.0, 0.0)])
    return knots[:, 0], knots[:, 1]
