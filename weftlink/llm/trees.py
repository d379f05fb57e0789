"""Regression trees over binned features: the base of the rule ensemble and of the random forest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays; feature -1 marks a leaf. A row goes left if its feature is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            goes = x[inner, f[inner]] <= self.threshold[node]
            at[inner] = np.where(goes, self.left[node], self.right[node])

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Conditions (feature, is_at_most, threshold) on the way to every node but the root."""
        out, stack = [], [(0, ())]
        while stack:
            node, path = stack.pop()
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = int(self.feature[node]), float(self.threshold[node])
                stack += [(int(self.left[node]), (*path, (f, True, t))), (int(self.right[node]), (*path, (f, False, t)))]
        return out


class Binned:
    """Features cut at quantiles, so that the best split of a node is found from counts."""

    def __init__(self, x: np.ndarray, bins: int = 48):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
        self.codes = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)]) if x.shape[1] else np.empty((len(x), 0), int)

    def grow(self, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int, least: int, features: int | None = None) -> Tree:
        """A tree that lowers the variance of ``y``; each node looks at ``features`` random columns."""
        nodes: list[list[float]] = []
        n_cols = self.codes.shape[1]

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            own = y[rows]
            nodes.append([-1, 0.0, -1, -1, float(own.mean())])
            if depth == 0 or len(rows) < 2 * least or own.min() == own.max():
                return at
            cols = rng.permutation(n_cols)[:features] if features else range(n_cols)
            best = (1e-12, -1, -1)
            total, n = own.sum(), len(rows)
            for c in cols:
                if not len(self.cuts[c]):
                    continue
                code = self.codes[rows, c]
                count = np.cumsum(np.bincount(code, minlength=len(self.cuts[c]) + 1))[:-1]
                left = np.cumsum(np.bincount(code, own, len(self.cuts[c]) + 1))[:-1]
                ok = (count >= least) & (n - count >= least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(c), k)
            _, c, k = best
            if c < 0:
                return at
            goes = self.codes[rows, c] <= k
            nodes[at][:2] = [c, float(self.cuts[c][k])]
            nodes[at][2] = node(rows[goes], depth - 1)
            nodes[at][3] = node(rows[~goes], depth - 1)
            return at

        node(rows, depth)
        a = np.asarray(nodes, np.float64)
        return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])
