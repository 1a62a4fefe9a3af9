"""Histogram gradient-boosted trees in numpy: fitted on a bounded sample, flattened into arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in heap order; row t of each array is tree t."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): left if value <= threshold
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log-odds of label 1 for each row of x; all trees descend together, a level at a time."""
        out = np.full(len(x), self.base)
        if not self.feature.size:
            return out
        trees, inner = np.arange(len(self.feature)), self.feature.shape[1]
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            node = np.zeros((len(part), len(trees)), np.int64)
            while node[0, 0] < inner:
                value = part[np.arange(len(part))[:, None], self.feature[trees, node]]
                node = 2 * node + 1 + (value > self.threshold[trees, node])
            out[at : at + rows] += self.leaf[trees, node - inner].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 48,
    penalty: float = 1.0,
    least: float = 2.0,
    monotone: dict[int, int] | None = None,
) -> Trees:
    """Fit logistic boosting.  monotone: feature number -> 1 or -1, the only direction in which it may move a score.

    A constrained split must order its two values; below it each side keeps to its half of the interval of
    values that its ancestors left, so that whole trees are monotonic.  With no rows or one label only the
    prior is kept.
    """
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float64)
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), base)
    if len(y) < 10 or y.min() == y.max():
        return none
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)  # bin b: value <= edge b
    usable = np.array([[b < len(e) for b in range(bins)] for e in edges])
    sign = np.array([(monotone or {}).get(k, 0) for k in range(m)])[:, None]
    f = np.full(n, base)
    all_f, all_t, all_l = [], [], []
    columns = np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        low, high = {0: -np.inf}, {0: np.inf}
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (m * bins) + columns + binned).ravel()
            both = [np.bincount(slot, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (g, h)]
            for k in range(width):
                at, (gl, hl) = first + k, (both[0][k], both[1][k])
                gt, ht = gl[0, -1], hl[0, -1]
                gr, hr = gt - gl, ht - hl
                lo, hi = low[at], high[at]
                left, right = (np.clip(-a / (b + penalty), lo, hi) for a, b in ((gl, hl), (gr, hr)))
                gain = -(gl * left + 0.5 * (hl + penalty) * left**2) - (gr * right + 0.5 * (hr + penalty) * right**2)
                own = np.clip(-gt / (ht + penalty), lo, hi)
                gain += gt * own + 0.5 * (ht + penalty) * own**2
                gain[~usable | (hl < least) | (hr < least) | (sign * (right - left) < 0)] = -np.inf
                best = int(gain.argmax())
                j, b = divmod(best, bins)
                for side in (2 * at + 1, 2 * at + 2):
                    low[side], high[side] = lo, hi
                if gain[j, b] > 1e-6:
                    feature[at], threshold[at] = j, edges[j][b]
                    if s := sign[j, 0]:
                        middle = (left[j, b] + right[j, b]) / 2
                        (high if s > 0 else low)[2 * at + 1] = middle
                        (low if s > 0 else high)[2 * at + 2] = middle
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        gs, hs = np.bincount(node - inner, g, leaves), np.bincount(node - inner, h, leaves)
        limits = np.array([[low[inner + k], high[inner + k]] for k in range(leaves)])
        leaf = rate * np.clip(-gs / (hs + penalty), limits[:, 0], limits[:, 1])
        f += leaf[node - inner]
        all_f.append(feature), all_t.append(threshold), all_l.append(leaf)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_l), base)
