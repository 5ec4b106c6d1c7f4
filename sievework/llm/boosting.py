"""Gradient-boosted symmetric trees with a softmax over classes, in numpy.

Every level of a tree tests one feature against one threshold for all its leaves; a leaf holds one value per class. The
tests of a tree are chosen on a random part of the rows and features, its values on all rows.
"""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, depth: int = 5, rounds: int = 60, rate: float = 0.25, bins: int = 24, penalty: float = 2.0, part: float = 0.5, seed: int = 5):
        self.part, self.seed = part, seed
        self.depth, self.rounds, self.rate, self.bins, self.penalty = depth, rounds, rate, bins, penalty
        self.tests: list[list[tuple[int, float]]] = []
        self.values: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> "Trees":
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # code > k: x above cut k
        width = self.bins
        target = np.eye(classes)[y]
        self.start = np.log(np.maximum(target.mean(0), 1e-6))
        raw = np.tile(self.start, (n, 1))
        rng = np.random.default_rng(self.seed)
        for _ in range(self.rounds):
            p = np.exp(raw - raw.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad, hess = target - p, p * (1 - p)
            some = np.sort(rng.choice(n, max(1, int(n * self.part)), replace=False))
            columns = np.sort(rng.choice(m, max(1, int(m * self.part)), replace=False))
            k_cols = len(columns)
            part, base = codes[np.ix_(some, columns)], np.arange(k_cols) * width
            leaf, tests = np.zeros(len(some), np.int64), []
            for level in range(self.depth):
                leaves = 1 << level
                at = (leaf[:, None] * k_cols * width + base + part).reshape(-1)
                gain = np.zeros((k_cols, width))
                for k in range(classes):
                    g = np.bincount(at, np.repeat(grad[some, k], k_cols), leaves * k_cols * width).reshape(leaves, k_cols, width)
                    h = np.bincount(at, np.repeat(hess[some, k], k_cols), leaves * k_cols * width).reshape(leaves, k_cols, width)
                    gl, hl = g.cumsum(2), h.cumsum(2)
                    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                    gain += (gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)).sum(0)
                for j, c in enumerate(columns):
                    gain[j, len(cuts[c]) :] = -1
                j, b = divmod(int(gain.argmax()), width)
                if gain[j, b] <= 1e-9:
                    j, b = 0, 0
                c = int(columns[j])
                cut = float(cuts[c][b]) if len(cuts[c]) else np.inf
                tests.append((c, cut))
                leaf = leaf * 2 + (x[some, c] > cut)
            leaf = np.zeros(n, np.int64)
            for j, cut in tests:
                leaf = leaf * 2 + (x[:, j] > cut)
            values = np.stack([self.rate * np.bincount(leaf, grad[:, k], 1 << self.depth) / (np.bincount(leaf, hess[:, k], 1 << self.depth) + self.penalty) for k in range(classes)], 1)
            raw += values[leaf]
            self.tests.append(tests)
            self.values.append(values)
        return self

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        raw = np.tile(self.start, (len(x), 1))
        columns = {j: np.ascontiguousarray(x[:, j]) for t in self.tests for j, _ in t}
        for tests, values in zip(self.tests, self.values):
            leaf = np.zeros(len(x), np.int32)
            for j, cut in tests:
                leaf = leaf * 2 + (columns[j] > cut)
            raw += values[leaf]
        raw -= raw.max(1, keepdims=True)
        return raw - np.log(np.exp(raw).sum(1, keepdims=True))
