"""Gradient-boosted trees for a yes or no, in numpy: histogram splits, logistic loss, full trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """A forest in arrays: of tree t, inner node i asks feature[t, i] > cut[t, i]; leaf holds the scores."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 70, depth: int = 4, bins: int = 32, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees for labels y (0 or 1). Splits are at quantiles of a feature; equal gains go to the first."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # x > e[b] iff bin > b
    mean = float((weight * y).sum() / weight.sum())
    base = float(np.log(mean / (1 - mean)))
    score, inner, leaves = np.full(len(y), base), 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            total_g, total_h = np.bincount(local, g, n), np.bincount(local, h, n)
            best = np.full(n, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * (len(e) + 1) + binned[j]
                left_g = np.bincount(key, g, n * (len(e) + 1)).reshape(n, -1).cumsum(1)[:, :-1]
                left_h = np.bincount(key, h, n * (len(e) + 1)).reshape(n, -1).cumsum(1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better] = top[better]
                f[first : first + n][better], c[first : first + n][better] = j, e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        local = at - inner
        v = rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + ridge)
        score += v[local]
        features.append(f)
        cuts.append(c)
        values.append(v)
    return Trees(np.array(features), np.array(cuts), np.array(values), base)
