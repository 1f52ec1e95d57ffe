"""Small gradient-boosted trees and isotonic calibration in numpy, for bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CUTS = 63


@dataclass
class Trees:
    """Complete binary trees of one depth: per tree the split features, cuts and leaf values."""

    depth: int
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting with second-order leaf values over histograms of the features."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1) + np.arange(d) * (CUTS + 1)
    odds = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(depth, float(np.log(odds / (1 - odds))))
    score = np.full(n, trees.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, v = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(n, dtype=np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            left = np.zeros(len(rows), dtype=bool)
            if len(rows) > 1:
                flat = binned[rows].ravel()
                gs, hs = (np.bincount(flat, np.repeat(w[rows], d), d * (CUTS + 1)).reshape(d, -1).cumsum(axis=1) for w in (g, h))
                gt, ht = g[rows].sum(), h[rows].sum()
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge)
                gain[(hs < least) | (ht - hs < least)] = -1
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > gt**2 / (ht + ridge) + 1e-9 and b < len(edges[j]):
                    f[at], c[at] = j, edges[j][b]
            left = x[rows, f[at]] <= c[at]
            node[rows] = 2 * at + 1 + ~left
        for leaf in range(inner + 1):
            rows = node == leaf + inner
            v[leaf] = rate * g[rows].sum() / (h[rows].sum() + ridge)
        score += v[node - inner]
        trees.features.append(f)
        trees.cuts.append(c)
        trees.leaves.append(v)
    return trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to ``y``: pool adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of w*y, of w, of w*score
    for s, t, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([w * t, w, w * s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
