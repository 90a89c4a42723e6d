"""Gradient-boosted trees of fixed depth for a yes or no answer, fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 4
BINS = 32


@dataclass
class Trees:
    """Perfect binary trees: per tree the features and limits of inner nodes, and leaf values."""

    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2 ** DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, least: float = 5.0) -> Trees:
    """Each tree fits the gradient of the log loss, level by level, over quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    odds = np.full(n, base)
    inner = 2 ** DEPTH - 1
    all_features = np.zeros((trees, inner), np.int64)
    all_limits = np.full((trees, inner), np.inf)
    all_leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            slot = (node - first) * BINS
            best = np.full(count, 1e-9)
            for j in range(width):
                g = np.bincount(slot + binned[:, j], gradient, count * BINS).reshape(count, BINS)
                h = np.bincount(slot + binned[:, j], curve, count * BINS).reshape(count, BINS)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, :len(edges[j])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for c in np.nonzero(top > best)[0]:
                    best[c] = top[c]
                    all_features[t, first + c] = j
                    all_limits[t, first + c] = edges[j][at[c]]
            right = x[np.arange(n), all_features[t, node]] > all_limits[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, curve, inner + 1)
        all_leaves[t] = rate * g / (h + 1)
        odds += all_leaves[t][leaf]
    return Trees(all_features, all_limits, all_leaves, base)
