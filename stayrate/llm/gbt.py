"""Gradient-boosted regression trees on binned features, for a bounded training sample; whole arrays at a time."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth as arrays: feature and bin of each inner node, value of each leaf."""

    def __init__(self, edges: list[np.ndarray], base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.edges, self.base, self.feature, self.cut, self.leaf = edges, base, feature, cut, leaf

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, edge in enumerate(self.edges):
            out[:, j] = np.searchsorted(edge, x[:, j], side="right")
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        binned, rows, total = self.bins(x), np.arange(len(x)), np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] >= cut[node])
            total += leaf[node - (leaf.shape[0] - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, n_bins: int = 32,
        smooth: float = 1.0) -> Boosted:
    """Logistic boosting; ties between cuts go to the first feature and the lowest bin, so a refit gives the same trees."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0)
             for j in range(x.shape[1])]
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base, n_inner = float(np.log(share / (1 - share))), 2**depth - 1
    model = Boosted(edges, base, np.zeros((0, n_inner), int), np.zeros((0, n_inner), int), np.zeros((0, n_inner + 1)))
    if not len(y):
        return model
    binned, total = model.bins(x), np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(n_inner, int), np.full(n_inner, 255, int), np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                flat, size = (node - first) * n_bins + binned[:, j], width * n_bins
                gs, hs = (np.bincount(flat, weights=w, minlength=size).reshape(width, n_bins) for w in (g, h))
                gl, hl = np.cumsum(gs, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
                ga, ha = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = at[better] + 1
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] >= cut[node])
        place = node - n_inner
        sums = [np.bincount(place, weights=w, minlength=n_inner + 1) for w in (g, h)]
        leaf = rate * sums[0] / (sums[1] + smooth)
        total += leaf[place]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(edges, base, np.array(features), np.array(cuts), np.array(leaves))
