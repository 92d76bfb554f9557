"""Histogram gradient-boosted trees for a 0/1 label, in numpy. Trees are full binary heaps kept in flat arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """feature and limit (trees, inner nodes), value (trees, leaves), start: the log-odds before any tree."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.feature, self.limit, self.value = [], [], []

    def freeze(self) -> Boosted:
        inner = (1 << self.depth) - 1
        self.feature = np.array(self.feature, np.int32).reshape(-1, inner)
        self.limit = np.array(self.limit, np.float64).reshape(-1, inner)
        self.value = np.array(self.value, np.float64).reshape(-1, 1 << self.depth)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum over all trees, each level of all trees and rows in one step."""
        out = np.full(len(x), self.start)
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x) if len(self.feature) else 0, 2048):
            some = x[at : at + 2048]
            rows = np.arange(len(some))[:, None]
            node = np.zeros((len(some), len(self.feature)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (some[rows, self.feature[trees, node]] > self.limit[trees, node])
            out[at : at + 2048] += self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature the values that a split may stand at: midpoints between neighbouring quantiles."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))
        values = np.unique(column)
        nearest = np.minimum(np.searchsorted(values, q, side="right"), len(values) - 1)
        out.append(np.unique((q + values[nearest]) / 2))
    return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the log loss. least: smallest sum of second derivatives in a leaf. With one class or no
    rows the score is the smoothed share of ones."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model.freeze()
    cuts = edges(x, bins)
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    n, f = x.shape
    flat = binned + np.arange(f) * width
    margin = np.full(n, model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        feature, limit = [], []
        for level in range(depth):
            size = f * width
            where = (flat + node[:, None] * size).ravel()
            shape = (1 << level, f, width)
            gs = np.bincount(where, np.repeat(g, f), minlength=size << level).reshape(shape)
            hs = np.bincount(where, np.repeat(h, f), minlength=size << level).reshape(shape)
            gl, hl = gs.cumsum(axis=2)[:, :, :-1], hs.cumsum(axis=2)[:, :, :-1]
            gt, ht = gs.sum(axis=2, keepdims=True), hs.sum(axis=2, keepdims=True)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(1 << level, -1).argmax(axis=1)
            bf, bb = best // (width - 1), best % (width - 1)
            split = gain.reshape(1 << level, -1).max(axis=1) > 1e-9
            # a node without a gain sends all its rows to the left
            lim = np.array([cuts[i][j] if s and j < len(cuts[i]) else np.inf for i, j, s in zip(bf, bb, split, strict=True)])
            feature += bf.tolist()
            limit += lim.tolist()
            node = 2 * node + (x[np.arange(n), bf[node]] > lim[node])
        gsum, hsum = np.bincount(node, g, minlength=1 << depth), np.bincount(node, h, minlength=1 << depth)
        value = rate * gsum / (hsum + ridge)
        model.feature += feature
        model.limit += limit
        model.value += value.tolist()
        margin += value[node]
    return model.freeze()
