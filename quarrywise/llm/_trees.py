"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trees:
    """Complete trees of one depth; node k has children 2k+1 and 2k+2."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.limit, self.leaf = base, feature, limit, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Histogram boosting: features are binned once by quantiles, splits are sought level by level."""
    n, d = x.shape
    mean = np.clip(np.average(y, weights=weight) if n else 0.5, 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    raw = np.full(n, base)
    features, limits, leaves = [], [], []
    for _ in range(rounds):
        p = sigmoid(raw)
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j in range(d):
                slot = (node - first) * bins + binned[:, j]
                gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)
                left, right = gs[:, :-1], gs[:, -1:] - gs[:, :-1]
                a, b = hs[:, :-1], hs[:, -1:] - hs[:, :-1]
                gain = left**2 / (a + ridge) + right**2 / (b + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                k = gain[:, : len(cuts[j])].argmax(1) if len(cuts[j]) else np.zeros(width, int)
                for i in range(width):
                    if len(cuts[j]) and gain[i, k[i]] > best[i] + 1e-9:
                        best[i], feature[first + i], limit[first + i] = gain[i, k[i]], j, cuts[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        at = node - (2**depth - 1)
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        raw += leaf[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(limits), np.array(leaves))


class Isotonic:
    """A rising step function by pooling adjacent violators, with straight lines between block centres.

    Equal raw values are one observation, their mean.
    """

    def __init__(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray):
        blocks: list[list[float]] = []  # sum of weights, of weighted y, of weighted raw
        value, which = np.unique(raw, return_inverse=True)
        total, good = (np.bincount(which, w, len(value)) for w in (weight, weight * y))
        for v, w, g in zip(value.tolist(), total.tolist(), good.tolist()):
            blocks.append([w, g, w * v])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.at = np.array([b[2] / b[0] for b in blocks])
        self.value = np.array([b[1] / b[0] for b in blocks])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated scores; one part in a thousand keeps the order within a step."""
        steps = np.interp(raw, self.at, self.value) if len(self.at) else sigmoid(raw)
        return 0.999 * steps + 0.001 * sigmoid(raw)
