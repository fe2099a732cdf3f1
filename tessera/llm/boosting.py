"""Logistic boosting on binned features, in NumPy.

Two learners share the split search: an ensemble of small trees over all
features, and an additive model whose trees see one feature (or one pair of
features) each, so that the sum of its trees is a lookup table per feature and
per pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SHRINK = 1.0  # added to the hessian of a leaf


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges of each column, at distinct quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)], axis=1).astype(np.int32)


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, last bin of the left side) of the best cut of binned sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
    k = int(np.argmax(gain))
    return float(gain[k]), k


@dataclass
class Additive:
    """A generalised additive model with pairwise interactions, as lookup tables."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    start: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a sum of table entries, then the logistic function."""
        out = np.full(len(x), self.start)
        b = to_bins(x, self.edges)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        if self.pairs:
            c = to_bins(x, self.coarse)
            for i, j, t in self.pairs:
                out += t[c[:, i], c[:, j]]
        return sigmoid(out)


def _steps(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, by bin, of a tree of this depth on one binned feature."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, d: int) -> None:
        gain, k = _best(g[a:b], h[a:b]) if d else (0.0, 0)
        if gain <= 1e-9:
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + SHRINK)
        else:
            grow(a, a + k + 1, d - 1)
            grow(a + k + 1, b, d - 1)

    grow(0, len(g), depth)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of a grid at one place of either axis."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = 0.0, None
    whole = G[-1, -1] ** 2 / (H[-1, -1] + SHRINK)
    for a in range(g.shape[0] - 1):
        q = [(G[a, :-1], H[a, :-1]), (G[a, -1] - G[a, :-1], H[a, -1] - H[a, :-1])]
        q += [(G[-1, :-1] - q[0][0], H[-1, :-1] - q[0][1]), (G[-1, -1] - G[a, -1] - G[-1, :-1] + G[a, :-1], H[-1, -1] - H[a, -1] - H[-1, :-1] + H[a, :-1])]
        if not len(q[0][0]):
            continue
        gain = sum(x**2 / (y + SHRINK) for x, y in q) - whole
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, where = float(gain[k]), (a, k)
    out = np.zeros_like(g)
    if where:
        a, k = where
        for s in (np.s_[: a + 1, : k + 1], np.s_[: a + 1, k + 1 :], np.s_[a + 1 :, : k + 1], np.s_[a + 1 :, k + 1 :]):
            out[s] = -g[s].sum() / (h[s].sum() + SHRINK)
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, coarse: int = 12, pairs: int = 8, pair_rounds: int = 50) -> Additive:
    """Cyclic boosting: in each round every feature in turn gets one shallow tree.

    Then the pairs of features whose grid explains most of what is left get
    trees of their own in the same way.  Without both labels the model is the
    constant prior, 0.5 without rows.
    """
    model = Additive(quantile_edges(x, bins), quantile_edges(x, coarse))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        model.start = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    p = y.mean()
    model.start = float(np.log(p / (1 - p)))
    b, f = to_bins(x, model.edges), np.full(len(y), model.start)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            s = sigmoid(f)
            g, h = np.bincount(b[:, j], s - y, len(t)), np.bincount(b[:, j], s * (1 - s), len(t))
            step = rate * _steps(g, h)
            t += step
            f += step[b[:, j]]
    c = to_bins(x, model.coarse)
    shape = [len(e) + 1 for e in model.coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, at = sigmoid(f), c[:, i] * shape[j] + c[:, j]
        n = shape[i] * shape[j]
        return np.bincount(at, s - y, n).reshape(shape[i], shape[j]), np.bincount(at, s * (1 - s), n).reshape(shape[i], shape[j]), at

    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            gain, _ = _quarters(*grids(i, j)[:2])
            found.append((gain, i, j))
    chosen = [(i, j) for _, i, j in sorted(found, key=lambda z: (-z[0], z[1], z[2]))[:pairs]]
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h, at = grids(i, j)
            step = rate * _quarters(g, h)[1]
            t += step
            f += step.ravel()[at]
    return model


@dataclass
class Forest:
    """Boosted trees of a fixed depth, each an array of nodes in heap order."""

    edges: list[np.ndarray]
    start: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, b = np.full(len(x), self.start), to_bins(x, self.edges)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Forest:
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    out = Forest(quantile_edges(x, bins), float(np.log(p / (1 - p))), depth, [])
    b, f = to_bins(x, out.edges), np.full(len(y), float(np.log(p / (1 - p))))
    for _ in range(trees):
        s = sigmoid(f)
        g, h = s - y, s * (1 - s)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 1 << 30, np.int64)
        at = np.zeros(len(y), np.int64)
        for node in range(2**depth - 1):
            inside = np.flatnonzero(at == node)
            if len(inside):
                best = max(((*_best(np.bincount(b[inside, j], g[inside], len(e) + 1), np.bincount(b[inside, j], h[inside], len(e) + 1)), -j) for j, e in enumerate(out.edges)), key=lambda z: (z[0], z[2]))
                if best[0] > 1e-9:
                    feature[node], cut[node] = -best[2], best[1]
                at[inside] = 2 * node + 1 + (b[inside, feature[node]] > cut[node])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + SHRINK)
        out.trees.append((feature, cut, value))
        f += value[leaf]
    return out
