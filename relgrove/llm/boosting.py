"""Histogram gradient-boosted trees for two classes, in numpy.

Features are binned at quantiles once; a tree grows level by level to a full
binary tree, and for each level the gradients of all nodes are summed per bin
by one ``bincount`` per feature. Trees are flattened into arrays (split
feature, threshold, value by node number), so that scoring walks all rows down
all trees with array lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold``: (trees, 2**depth - 1); ``value``: (trees, 2**depth); ``base``: log-odds to start with."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of features."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner] if len(x) else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def constant(p: float) -> Trees:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((0, 0), np.int32), np.zeros((0, 0)), np.zeros((0, 1)), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, min_child: float = 2.0) -> Trees:
    """Trees for rows ``x`` and labels ``y`` (0 or 1); the prior alone where one class is missing."""
    n, k = x.shape
    if not n or y.min() == y.max():
        return constant((y.sum() + 0.5) / (n + 1))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(k)])  # bin b holds cuts[b - 1] < v <= cuts[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(n, base), (1 << depth) - 1
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)  # number within the level
        for level in range(depth):
            width = 1 << level
            best, choice = np.zeros(width), [(0, np.inf)] * width
            gs, hs = (np.bincount(node, w, width) for w in (g, h))
            whole = gs**2 / (hs + l2)
            for j in range(k):
                size = len(cuts[j]) + 1
                if size == 1:
                    continue
                at = node * size + binned[j]
                gl, hl = (np.cumsum(np.bincount(at, w, width * size).reshape(width, size), axis=1)[:, :-1] for w in (g, h))
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole[:, None]
                gain[(hl < min_child) | (hr < min_child)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                for m in np.flatnonzero(top > best + 1e-9):
                    best[m], choice[m] = top[m], (j, cuts[j][cut[m]])
            first = width - 1
            for m, (j, c) in enumerate(choice):
                feature[first + m], threshold[first + m] = j, c
            node = 2 * node + (x[np.arange(n), feature[first + node]] > threshold[first + node])
        gs, hs = (np.bincount(node, w, inner + 1) for w in (g, h))
        value = -rate * gs / (hs + l2)
        margin += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)
