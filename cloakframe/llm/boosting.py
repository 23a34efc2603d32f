"""Gradient-boosted regression trees for small labelled tables, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Squared-error boosting with depth-limited trees; rows may carry weights.

    Meant for labelled tables of a bounded size (thousands of rows): splits are
    exact, so a fit costs ``rounds * 2**depth * features * rows * log(rows)``.
    """

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base = 0.0
        self.feature = np.zeros((0, 0), np.int32)
        self.threshold = np.zeros((0, 0))
        self.value = np.zeros((0, 0))

    def _split(self, x: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[int, float] | None:
        best, gain = None, 1e-9
        whole = (r * w).sum() ** 2 / w.sum()
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v = x[order, j]
            sw, sr = np.cumsum(w[order]), np.cumsum((r * w)[order])
            ok = (v[1:] > v[:-1]) & (sw[:-1] >= self.least) & (sw[-1] - sw[:-1] >= self.least)
            if not ok.any():
                continue
            score = np.where(ok, sr[:-1] ** 2 / sw[:-1] + (sr[-1] - sr[:-1]) ** 2 / np.maximum(sw[-1] - sw[:-1], 1e-12), -np.inf)
            k = int(np.argmax(score))
            if score[k] - whole > gain:
                best, gain = (j, float((v[k] + v[k + 1]) / 2)), score[k] - whole
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight.astype(float)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.base = float(np.average(y, weights=w))
        self.feature = np.zeros((self.rounds, inner), np.int32)
        self.threshold = np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, leaves))
        now = np.full(len(y), self.base)
        for t in range(self.rounds):
            r, node = y - now, np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    here = node == k
                    if here.any() and (found := self._split(x[here], r[here], w[here])):
                        self.feature[t, k], self.threshold[t, k] = found
                node = 2 * node + 1 + (x[np.arange(len(y)), self.feature[t, node]] > self.threshold[t, node])
            leaf = node - inner
            total = np.bincount(leaf, w, leaves)
            self.value[t] = self.rate * np.bincount(leaf, w * r, leaves) / np.maximum(total, 1e-12)
            now += self.value[t, leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for t in range(len(self.value)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            out += self.value[t, node - inner]
        return out
