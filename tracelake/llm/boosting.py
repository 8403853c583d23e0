"""Gradient-boosted trees and isotonic calibration in numpy, for models of a few dozen features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting over quantile bins: trees of fixed depth kept as arrays."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros(x.shape, int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            mid = (v[1:] + v[:-1]) / 2
            self.cuts.append(mid if len(mid) < self.bins else np.unique(np.quantile(mid, q)))
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f, n_bins = np.full(len(y), self.start), self.bins + 1
        for _ in range(self.rounds):
            mu = 1 / (1 + np.exp(-f))
            g, h = mu - y, np.maximum(mu * (1 - mu), 1e-9)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                lo, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                rel = node - lo
                live = rel >= 0
                for j in range(x.shape[1]):
                    at = rel[live] * n_bins + b[live, j]
                    gs = np.bincount(at, g[live], width * n_bins).reshape(width, n_bins)
                    hs = np.bincount(at, h[live], width * n_bins).reshape(width, n_bins)
                    gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better] = top[better]
                    feature[lo : lo + width][better] = j
                    cut[lo : lo + width][better] = k[better]
                split = live & (feature[node] >= 0)
                go = b[np.arange(len(y)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(split, 2 * node + 1 + go, node)
            gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
            value = -self.rate * gs / (hs + self.l2)
            f += value[node]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        if not len(x):
            return f
        b, rows = self._binned(x), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[node]
                go = b[rows, np.maximum(j, 0)] > cut[node]
                node = np.where(j >= 0, 2 * node + 1 + go, node)
            f += value[node]
        return f


class Isotonic:
    """Nondecreasing fit by pooling adjacent violators; each block is smoothed by half a row of either label."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # least score, greatest score, sum, rows
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            if blocks and blocks[-1][1] == s:
                blocks[-1][2] += v
                blocks[-1][3] += 1
            else:
                blocks.append([s, s, v, 1])
            while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
        self.x = np.array([e for b in blocks for e in (b[0], b[1])] or [0.0])
        self.y = np.maximum.accumulate(np.array([(b[2] + 0.5) / (b[3] + 1) for b in blocks for _ in (0, 1)] or [0.5]))
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
