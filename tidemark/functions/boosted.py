"""Boosted regression trees in numpy: second-order, histogram-based, with both leaf penalties and sampling.

One series, horizon and parameter set is one fit inside a task; Spark deals out the fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEFAULTS = {
    "n_estimators": 200, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.9,
    "min_child_weight": 10.0, "reg_alpha": 0.0, "reg_lambda": 5.0, "objective": "squared",
}
BINS = 64


@dataclass
class Regressor:
    params: dict
    base: float = 0.0
    trees: list[list[tuple]] = field(default_factory=list)
    gain: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.part(x, self.trees)

    def part(self, x: np.ndarray, trees: list[list[tuple]]) -> np.ndarray:
        """What some of the trees add."""
        out = np.zeros(len(x))
        for nodes in trees:
            at = np.zeros(len(x), np.int64)
            feature, threshold, left, value = (np.array(c) for c in zip(*nodes, strict=True))
            for _ in range(self.params["max_depth"]):
                go = left[at] > 0
                right = x[np.arange(len(x)), feature[at]] > threshold[at]
                at = np.where(go, left[at] + right, at)
            out += value[at]
        return out


    def using(self, feature: int) -> list[list[tuple]]:
        """The trees that split on a feature."""
        return [t for t in self.trees if any(left and j == feature for j, _, left, _ in t)]


@dataclass(frozen=True)
class Binned:
    """Features cut into bins at quantiles; fits on the same rows can share it."""

    edges: list[np.ndarray]
    bins: np.ndarray  # (rows, features): bin b holds values up to edge b
    key: np.ndarray  # the same, numbered over all features

    @classmethod
    def of(cls, x: np.ndarray) -> Binned:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        return cls(edges, bins, bins + np.arange(x.shape[1]) * BINS)

    def unusable(self, columns: np.ndarray) -> np.ndarray:
        """(features, bins): where a tree over these columns cannot split, as the column is not among them or the bin has no edge."""
        out = np.array([len(e) for e in self.edges])[:, None] <= np.arange(BINS)
        out[np.setdiff1d(np.arange(len(self.edges)), columns)] = True
        return out


def fit(x: np.ndarray, y: np.ndarray, params: dict | None = None, seed: int = 42, binned: Binned | None = None) -> Regressor:
    """Fit on rows of features without gaps.  objective: squared or absolute (leaves then take the sign's gradient)."""
    p = DEFAULTS | (params or {})
    model = Regressor(p, float(np.median(y) if p["objective"] == "absolute" else np.mean(y)), [], np.zeros(x.shape[1]))
    rng, (n, m) = np.random.default_rng(seed), x.shape
    binned = binned or Binned.of(x)
    f = np.full(n, model.base)
    for _ in range(p["n_estimators"]):
        g = np.sign(f - y) if p["objective"] == "absolute" else f - y
        rows = rng.permutation(n)[: max(1, int(n * p["subsample"]))]
        columns = np.sort(rng.permutation(m)[: max(1, int(round(m * p["colsample_bytree"])))])
        nodes = _grown(binned, rows, columns, g[rows], p, model.gain)
        model.trees.append([(j, float(binned.edges[j][b]) if left else np.inf, left, value) for j, b, left, value in nodes])
        f += _reached(nodes, binned.bins, p["max_depth"])
    return model


def _grown(binned: Binned, rows: np.ndarray, columns: np.ndarray, g: np.ndarray, p: dict, gain: np.ndarray) -> list[tuple]:
    """A tree as nodes (feature, bin, first child or 0, value), grown level by level.

    Of two siblings only the smaller one's histogram is counted; the other's is what is left of the parent's.  Histograms are of all features: leaving
    some out costs more than counting them.
    """
    lam, alpha, least, wide = np.float32(p["reg_lambda"]), np.float32(p["reg_alpha"]), np.float32(p["min_child_weight"]), binned.key.shape[1] * BINS
    soft = (lambda v: np.sign(v) * np.maximum(np.abs(v) - alpha, 0.0)) if alpha else (lambda v: v)
    value = lambda total, weight: float(-p["learning_rate"] * soft(total) / (weight + lam))
    m, closed = binned.key.shape[1], binned.unusable(columns)

    def histograms(among: np.ndarray | None, node: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        slot = binned.key[rows if among is None else rows[among]]
        if n > 1:
            slot += (node * wide)[:, None]
        slot = slot.ravel()
        sums = np.bincount(slot, np.repeat(g if among is None else g[among], m), n * wide).astype(np.float32)
        return sums.reshape(n, m, BINS), np.bincount(slot, minlength=n * wide).astype(np.float32).reshape(n, m, BINS)

    nodes, level, at = [(0, 0, 0, value(g.sum(), len(g)))], [0], np.zeros(len(rows), np.int64)
    sums, counts = histograms(None, None, 1)
    for depth in range(p["max_depth"]):
        gl, hl = sums.cumsum(2), counts.cumsum(2)
        total, weight = gl[:, :1, -1:], hl[:, :1, -1:]
        hr = weight - hl
        score, other = soft(gl) ** 2, soft(total - gl) ** 2
        score /= hl + lam
        other /= hr + lam
        score += other
        score[(hl < least) | (hr < least) | closed] = -np.inf
        flat, n = score.reshape(len(level), -1), np.arange(len(level))
        best = flat.argmax(1)
        rise = flat[n, best] - (soft(total) ** 2 / (weight + lam))[:, 0, 0]
        column, b = np.divmod(best, BINS)
        split = np.flatnonzero((rise > 1e-12) & (weight[:, 0, 0] >= 2 * least))
        if not len(split):
            break
        left_g, left_h = gl[n, column, b], hl[n, column, b]
        fresh, following = np.full(len(level), -1), []
        # Pairs of children that are both too small to split are done.
        goes = np.maximum(left_h, weight[:, 0, 0] - left_h) >= 2 * least
        for k in split.tolist():
            j, first = int(column[k]), len(nodes)
            gain[j] += rise[k]
            nodes[level[k]] = (j, int(b[k]), first, nodes[level[k]][3])
            nodes += [(0, 0, 0, value(left_g[k], left_h[k])), (0, 0, 0, value(total[k, 0, 0] - left_g[k], weight[k, 0, 0] - left_h[k]))]
            if goes[k]:
                fresh[k] = len(following)
                following += [first, first + 1]
        split = split[goes[split]]
        if depth + 1 == p["max_depth"] or not following:
            break
        live = np.flatnonzero(at >= 0)
        went = fresh[at[live]]
        right = binned.bins[rows[live], column[at[live]]] > b[at[live]]
        at[live] = np.where(went < 0, -1, went + right)
        level = following
        smaller = 2 * left_h[split] > weight[split, 0, 0]  # whether the right child is
        live = live[went >= 0]
        counted = live[(at[live] & 1) == smaller[at[live] >> 1]]
        few = histograms(counted, at[counted] >> 1, len(split))
        rest = sums[split] - few[0], counts[split] - few[1]
        pick = smaller[:, None, None]
        sums, counts = (np.stack([np.where(pick, r, f), np.where(pick, f, r)], 1).reshape(-1, m, BINS) for f, r in zip(few, rest, strict=True))
    return nodes


def _reached(nodes: list[tuple], bins: np.ndarray, depth: int) -> np.ndarray:
    """The value of the leaf that each row ends in."""
    feature, threshold, left, value = (np.array(c) for c in zip(*nodes, strict=True))
    at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        right = bins[row, feature[at]] > threshold[at]
        at = np.where(left[at] > 0, left[at] + right, at)
    return value[at]
