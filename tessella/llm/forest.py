"""Histogram gradient-boosted trees for binary labels, in numpy arrays.

Features are cut into at most ``BINS`` bins by the quantiles of the training rows. Trees grow level by level: one histogram of
gradients and curvatures per node and feature gives the best split of every node of a level at once. A tree of depth d is
stored as a complete tree in flat arrays (feature, cutoff; leaf values), so that scoring walks all rows down together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``cutoff``: trees x inner nodes in level order; ``leaf``: trees x leaves; ``bias``: the score of no tree."""

    feature: np.ndarray
    cutoff: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(rows), self.bias)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, cutoff, leaf in zip(self.feature, self.cutoff, self.leaf):
            node = np.zeros(len(rows), np.int64)
            while inner and len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (rows[every, feature[node]] > cutoff[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def train(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Forest:
    """Fit ``labels`` (0 or 1) to ``rows``; without rows of both labels, the forest has no tree and scores the mean (or a half)."""
    n, width = rows.shape
    mean = (labels.sum() + 1) / (n + 2)
    bias, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    if n == 0 or labels.min() == labels.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    total = np.full(n, bias)
    features, cutoffs, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve = p - labels, p * (1 - p)
        feature, cutoff = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            size, offset = 2**level, 2**level - 1
            best = np.zeros(size)
            pick, at = np.zeros(size, np.int64), np.full(size, BINS)
            for f in range(width):
                key = (node - offset) * BINS + binned[:, f]
                g = np.bincount(key, grad, size * BINS).reshape(size, BINS).cumsum(1)
                h = np.bincount(key, curve, size * BINS).reshape(size, BINS).cumsum(1)
                c = np.bincount(key, minlength=size * BINS).reshape(size, BINS).cumsum(1)
                g1, h1, c1 = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (g1 - g) ** 2 / (h1 - h + ridge) - g1**2 / (h1 + ridge)
                gain[(c < least) | (c1 - c < least)] = 0
                gain[:, len(edges[f]) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(size), b] > best + 1e-9
                best[better], pick[better], at[better] = gain[np.arange(size), b][better], f, b[better]
            for k in range(size):
                if at[k] < BINS:
                    feature[offset + k], cutoff[offset + k] = pick[k], edges[pick[k]][at[k]]
            right = binned[np.arange(n), pick[node - offset]] > at[node - offset]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, curve, inner + 1)
        value = -rate * g / (h + ridge)
        total += value[leaf]
        features.append(feature), cutoffs.append(cutoff), leaves.append(value)
    return Forest(np.array(features), np.array(cutoffs), np.array(leaves), bias)
