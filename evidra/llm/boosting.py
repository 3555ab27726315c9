"""Gradient-boosted trees for a binary label in numpy, kept as flat node arrays, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees are complete binary trees of one depth: node i has the children 2i+1 (x <= threshold) and 2i+2.

    feature, threshold: trees x inner nodes; leaf: trees x leaves. A node that isn't split sends all rows left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 2.0, fewest: int = 3) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins.

    monotone: feature -> +1 (score may only rise with it) or -1; kept by refusing splits whose children's values are in
    the wrong order and by bounding what stands below a split by the mean of its children's values.
    Both classes weigh the same in all, however rare one is. least, fewest: second derivatives and rows of a child, at
    least. With no rows, or one class only, the result has no trees and a constant score."""
    monotone = monotone or {}
    n, k = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    weight, base = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum()))), 0.0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)  # bin b: x <= edges[b]
    score = np.full(n, base)
    feature, threshold, leaf = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = weight * (prob - y), weight * np.maximum(prob * (1 - prob), 1e-6)
        f, t, v = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            lo, hi = bounds[i]
            bounds[2 * i + 1] = bounds[2 * i + 2] = (lo, hi)
            at = np.flatnonzero(node == i)
            best = (1e-6, -1, -1, 0.0)
            if len(at):
                gs, hs = g[at].sum(), h[at].sum()
                for j in range(k):
                    m = len(edges[j])
                    if not m:
                        continue
                    gl = np.cumsum(np.bincount(binned[at, j], g[at], m + 1))[:m]
                    hl = np.cumsum(np.bincount(binned[at, j], h[at], m + 1))[:m]
                    left, right = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    rows = np.cumsum(np.bincount(binned[at, j], minlength=m + 1))[:m]
                    gain[(hl < least) | (hs - hl < least) | (rows < fewest) | (len(at) - rows < fewest)] = 0
                    if j in monotone:
                        gain[monotone[j] * (right - left) < 0] = 0
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, b, float(left[b] + right[b]) / 2)
            _, j, b, mid = best
            if j >= 0:
                f[i], t[i] = j, edges[j][b]
                if (d := monotone.get(j)) is not None:
                    bounds[2 * i + 1], bounds[2 * i + 2] = ((lo, mid), (mid, hi)) if d > 0 else ((mid, hi), (lo, mid))
                node[at] = 2 * i + 1 + (binned[at, j] > b)
            else:
                node[at] = 2 * i + 1
        for i in range(leaves):
            at = node == inner + i
            lo, hi = bounds[inner + i]
            v[i] = rate * float(np.clip(-g[at].sum() / (h[at].sum() + l2), lo, hi)) if at.any() else 0.0
        score += v[node - inner]
        feature.append(f), threshold.append(t), leaf.append(v)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), base, depth)
