"""Gradient-boosted trees in numpy, flattened into node arrays for vectorised scoring.

Training takes a bounded sample in memory: features are cut into quantile bins, trees grow level by
level from gradient histograms, and a monotonic constraint on a feature (+1 or -1) rules out splits
that go the other way and bounds the values of all that lies below a split on it.

A model is three arrays over complete binary trees: the feature and the threshold of each inner
node, and the value of each leaf. A node that did not split has an infinite threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x`` (rows, features)."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1] if self.feature.size else 0
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -35, 35)))


def constant(p: float) -> Trees:
    """No tree: the same odds for all."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((0, 0), np.int32), np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(p / (1 - p))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotonic: dict[int, int] | None = None,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    l2: float = 1.0,
    least_weight: float = 2.0,
) -> Trees:
    """Minimise log loss of 0/1 labels ``y``."""
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, width = x.shape
    direction = np.zeros(width, np.int64)
    for k, d in (monotonic or {}).items():
        direction[k] = d
    # Thresholds lie between distinct values, so rows exactly on one are never split from each other.
    edges, binned = [], np.zeros((n, width), np.int64)
    for k in range(width):
        values = np.unique(x[:, k])
        middles = (values[:-1] + values[1:]) / 2
        if len(middles) > BINS - 1:
            middles = np.unique(middles[np.searchsorted(values[1:], np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).clip(0, len(middles) - 1)])
        edges.append(middles)
        binned[:, k] = np.searchsorted(middles, x[:, k], "left")
    base = constant(float(y.mean())).base
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    all_features, all_thresholds, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            cell = (at[:, None] * width + np.arange(width)) * BINS + binned
            shape = (count, width, BINS)
            g = np.bincount(cell.ravel(), np.repeat(gradient, width), count * width * BINS).reshape(shape)
            h = np.bincount(cell.ravel(), np.repeat(weight, width), count * width * BINS).reshape(shape)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            lo, hi = low[first : first + count, None, None], high[first : first + count, None, None]
            left, right = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            gain = -(2 * gl * left + (hl + l2) * left**2) - (2 * gr * right + (hr + l2) * right**2)
            whole = np.clip(-gt / (ht + l2), lo, hi)
            gain += 2 * gt * whole + (ht + l2) * whole**2
            wrong = ((right - left) * direction[None, :, None] < 0) | (hl < least_weight) | (hr < least_weight)
            gain[wrong] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for i in range(count):
                here = first + i
                k, b = divmod(int(best[i]), BINS)
                low[2 * here + 1 : 2 * here + 3], high[2 * here + 1 : 2 * here + 3] = low[here], high[here]
                if flat[i, best[i]] <= 1e-9 or b >= len(edges[k]):
                    continue
                feature[here], threshold[here] = k, edges[k][b]
                if direction[k]:
                    middle = (left[i, k, b] + right[i, k, b]) / 2
                    above, below = (2 * here + 2, 2 * here + 1) if direction[k] > 0 else (2 * here + 1, 2 * here + 2)
                    low[above], high[below] = middle, middle
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        g, h = np.bincount(at, gradient, leaves), np.bincount(at, weight, leaves)
        value = rate * np.clip(-g / (h + l2), low[inner:], high[inner:])
        margin += value[at]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_values.append(value)
    return Trees(np.array(all_features), np.array(all_thresholds), np.array(all_values), base)
