"""Gradient-boosted regression trees for a binary target, on histograms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of equal depth: feature and cut of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        index = np.arange(len(rows))
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[index, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total


def boost(rows: np.ndarray, target: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 48, penalty: float = 2.0) -> Boosted:
    """Newton steps on the logistic loss; deterministic."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)])
    share = min(max(target.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(rows), base)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = target - p, p * (1 - p)
        at = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            local = at - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * (len(e) + 1) + binned[:, f]
                gs = np.bincount(key, g, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(key, h, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best + 1e-9):
                    best[node], features[t, first + node], cuts[t, first + node] = top[node], f, e[k[node]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), features[t, at]] > cuts[t, at])
        slot = at - inner
        values[t] = rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + penalty)
        margin += values[t, slot]
    return Boosted(base, features, cuts, values)
