"""Gradient-boosted trees for a yes or no label, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 16


class BoostedTrees:
    """Trees of fixed depth in arrays; each inner node asks whether a feature's bin is above a number."""

    def __init__(self, edges: list[np.ndarray], depth: int) -> None:
        self.edges, self.depth = edges, depth
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.base = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.3, ridge: float = 2.0, least: float = 4.0) -> BoostedTrees:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = BoostedTrees(edges, depth)
    share = y.mean()
    model.base = float(np.log(share / (1 - share)))
    b = model.bins(x).astype(np.int64)
    score = np.full(len(x), model.base)
    offsets = np.arange(x.shape[1]) * (BINS + 1)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                cells = (b[rows] + offsets).ravel()
                shape = (x.shape[1], BINS + 1)
                gs = np.bincount(cells, np.repeat(g[rows], x.shape[1]), offsets[-1] + BINS + 1).reshape(shape).cumsum(1)
                hs = np.bincount(cells, np.repeat(h[rows], x.shape[1]), offsets[-1] + BINS + 1).reshape(shape).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[node], cut[node] = divmod(best, BINS + 1)
            at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += value[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.values.append(value)
    return model
