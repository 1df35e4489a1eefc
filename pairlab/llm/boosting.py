"""A small gradient-boosted tree classifier in numpy (logistic loss, binned features)."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of fixed depth over binned features; ``score`` gives log odds."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, shrink: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.shrink, self.least = rounds, depth, rate, shrink, least
        self.start, self.edges, self.trees = 0.0, [], []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b, y = self._bin(x), y.astype(float)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """One tree as (split feature, split bin) for each inner node of a full binary tree, and leaf values."""
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, BINS, int)  # cut BINS: all go left
        node = np.zeros(len(g), int)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            best = 1e-6
            if len(at):
                total_g, total_h = g[at].sum(), h[at].sum()
                for j in range(b.shape[1]):
                    gs = np.cumsum(np.bincount(b[at, j], g[at], BINS))[:-1]
                    hs = np.cumsum(np.bincount(b[at, j], h[at], BINS))[:-1]
                    n = np.cumsum(np.bincount(b[at, j], minlength=BINS))[:-1]
                    gain = gs ** 2 / (hs + self.shrink) + (total_g - gs) ** 2 / (total_h - hs + self.shrink) - total_g ** 2 / (total_h + self.shrink)
                    gain[(n < self.least) | (len(at) - n < self.least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[i], cut[i] = gain[k], j, k
                node[at] = 2 * i + 1 + (b[at, feature[i]] > cut[i])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return (feature, cut, self.rate * gs / (hs + self.shrink)), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f


def precise_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out precision is kept; infinity if it never is."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    good = hits / np.arange(1, len(s) + 1) >= precision
    last = np.append(s[1:] != s[:-1], True)  # a threshold takes all of its ties
    at = np.flatnonzero(good & last)
    return float(s[at[-1]]) if len(at) and hits[at[-1]] else float("inf")
