"""Gradient-boosted trees over small integer features, in numpy."""

from __future__ import annotations

import numpy as np

#: Features are integers below this.
BINS = 16


class BoostedTrees:
    """Complete binary trees of one depth; a row goes right where its feature exceeds the threshold."""

    def __init__(self, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray, base: float, depth: int):
        self.features, self.thresholds, self.leaves, self.base, self.depth = features, thresholds, leaves, base, depth

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        flat, width = rows.ravel(), rows.shape[1]
        start = np.arange(len(rows)) * width
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat[start + f[at]] > t[at])
            out += leaf[at - len(f)]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


def fit(
    rows: np.ndarray, labels: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 2.0, least: float = 2.0
) -> BoostedTrees:
    """Logistic boosting; splits by the histogram of gradients in every feature."""
    n, width = rows.shape
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    cells = np.arange(width) * BINS + rows.astype(np.int64)
    all_f, all_t, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            index = ((at - first)[:, None] * (width * BINS) + cells).ravel()
            size = count * width * BINS
            g = np.bincount(index, np.repeat(gradient, width), size).reshape(count, width, BINS)
            h = np.bincount(index, np.repeat(weight, width), size).reshape(count, width, BINS)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                if gain.reshape(count, -1)[k, best[k]] > 1e-6:
                    feature[first + k], threshold[first + k] = divmod(int(best[k]), BINS)
            at = 2 * at + 1 + (rows[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        g, h = np.bincount(leaf, gradient, 2**depth), np.bincount(leaf, weight, 2**depth)
        values = rate * g / (h + ridge)
        margin += values[leaf]
        all_f.append(feature)
        all_t.append(threshold)
        all_l.append(values)
    return BoostedTrees(np.array(all_f), np.array(all_t), np.array(all_l), base, depth)
