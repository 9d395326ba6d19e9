"""Gradient-boosted trees for binary labels, small enough to train on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def _quantiles(c: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Linear quantiles of values that stand ``w`` times each, as if they were written out."""
    order = np.argsort(c, kind="stable")
    v, upto = c[order], np.cumsum(w[order])
    at = q * (upto[-1] - 1)
    low = np.floor(at)
    a, b = (v[np.searchsorted(upto, i, side="right")] for i in (low, np.minimum(low + 1, upto[-1] - 1)))
    return a + (b - a) * (at - low)


class Boosted:
    """Logistic boosting of shallow trees over quantile bins. Trained models are plain arrays and travel in closures."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, leaf: float = 4.0, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.smooth = rounds, depth, rate, bins, leaf, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, groups: np.ndarray | None = None) -> Boosted:
        """Learn from rows that stand ``weight`` times each, a whole number; once if none is given. With ``groups`` (numbers
        from 0) it is a ranking: a row's chance is that among its group's rows and none of them, which scores 0."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        share = ((w * y).sum() + 0.5) / (w.sum() + 1)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(_quantiles(c, w, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
        score = np.full(len(y), self.base)
        nodes = 2**self.depth - 1
        for _ in range(self.rounds):
            up = np.exp(score)
            p = up / (1 + (up if groups is None else np.bincount(groups, up)[groups]))
            g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-9)
            feature, value, out = np.full(nodes, -1), np.zeros(nodes), np.zeros(2 * nodes + 1)
            at = np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                out[node] = gs / (hs + self.smooth)
                best, gain0 = (1e-6, -1, -1), gs * gs / (hs + self.smooth)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = codes[rows, f]
                    gl = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
                    n = np.cumsum(np.bincount(k, w[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + self.smooth) + (gs - gl) ** 2 / (hs - hl + self.smooth) - gain0
                    gain[(n < self.leaf) | (w[rows].sum() - n < self.leaf)] = -1
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], f, b)
                if best[1] >= 0:
                    feature[node], value[node] = best[1], cuts[best[1]][best[2]]
                    at[rows] = 2 * node + 1 + (codes[rows, best[1]] > best[2])
            for leaf in range(nodes, 2 * nodes + 1):
                rows = np.flatnonzero(at == leaf)
                if len(rows):
                    out[leaf] = g[rows].sum() / (h[rows].sum() + self.smooth)
            self.trees.append((feature, value, out * self.rate))
            score += out[at] * self.rate
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the label, or a ranking's scores."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for feature, value, out in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = at < len(feature)
                f = np.where(inner, feature[np.minimum(at, len(feature) - 1)], -1)
                go = f >= 0
                at = np.where(go, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > value[np.minimum(at, len(value) - 1)]), at)
            score += out[at]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the label."""
        return 1 / (1 + np.exp(-self.scores(x)))
