"""Gradient-boosted trees for several classes, over a bounded matrix on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class BoostedTrees:
    """Second-order boosting of depth-limited trees over quantile bins, one tree per class and round."""

    classes: tuple[str, ...]
    rounds: int = 40
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    ridge: float = 1.0
    #: Share of the columns that a tree may split on, drawn anew for every tree: no single one decides.
    columns: float = 1.0
    seed: int = 7
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)
    start: np.ndarray | None = None
    scale: float = 1.0
    shift: np.ndarray | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, f = x.shape
        k = len(self.classes)
        weight = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = self._binned(x)
        flat = b + np.arange(f, dtype=np.int32) * self.bins
        onehot = np.eye(k)[y]
        share = np.maximum((onehot * weight[:, None]).sum(0) / weight.sum(), 1e-4)
        self.start = np.log(share)
        z = np.tile(self.start, (n, 1))
        draw = np.random.default_rng(self.seed)
        some = max(1, round(self.columns * f))
        for _ in range(self.rounds):
            p = _softmax(z)
            round_trees = []
            for c in range(k):
                g, h = weight * (p[:, c] - onehot[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree, leaf = self._grow(b, flat, g, h, f, np.sort(draw.choice(f, some, replace=False)))
                round_trees.append(tree)
                z[:, c] += self.rate * tree[2][leaf]
            self.trees.append(round_trees)
        return self

    def _grow(self, b: np.ndarray, flat: np.ndarray, g: np.ndarray, h: np.ndarray, f: int, use: np.ndarray) -> tuple[tuple, np.ndarray]:
        size = 2**self.depth
        split_on, split_at = np.zeros(size, np.int32), np.full(size, self.bins, np.int32)
        node = np.ones(len(g), np.int32)
        for level in range(self.depth):
            for m in range(2**level, 2 ** (level + 1)):
                rows = np.flatnonzero(node == m)
                if len(rows) < 10:
                    continue
                cells = flat[np.ix_(rows, use)].ravel()
                hg = np.bincount(cells, np.repeat(g[rows], len(use)), f * self.bins).reshape(f, self.bins)[use].cumsum(1)
                hh = np.bincount(cells, np.repeat(h[rows], len(use)), f * self.bins).reshape(f, self.bins)[use].cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + self.ridge) + (tg - hg) ** 2 / (th - hh + self.ridge) - tg**2 / (th + self.ridge)
                gain[(hh < 1e-3) | (th - hh < 1e-3)] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    split_on[m], split_at[m] = use[best // self.bins], best % self.bins
            node = 2 * node + (b[np.arange(len(g)), split_on[node]] > split_at[node])
        leaf = node - size
        value = -np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
        return (split_on, split_at, value), leaf

    def decision(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows, size = np.arange(len(x)), 2**self.depth
        z = np.tile(self.start, (len(x), 1))
        for round_trees in self.trees:
            for c, (split_on, split_at, value) in enumerate(round_trees):
                node = np.ones(len(x), np.int32)
                for _ in range(self.depth):
                    node = 2 * node + (b[rows, split_on[node]] > split_at[node])
                z[:, c] += self.rate * value[node - size]
        return z

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.decision(x) * self.scale + (0 if self.shift is None else self.shift))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> BoostedTrees:
        """Temperature and class offsets of least log loss (with a small pull to 1 and 0) on held-out rows."""
        z, onehot = self.decision(x), np.eye(len(self.classes))[y]
        log_scale, shift = 0.0, np.zeros(len(self.classes))
        for _ in range(steps):
            d = (_softmax(z * np.exp(log_scale) + shift) - onehot) / len(x)
            log_scale -= 0.1 * ((d * z).sum() * np.exp(log_scale) + 0.05 * log_scale)
            shift -= 0.1 * (d.sum(0) + 0.5 * shift)
        self.scale, self.shift = float(np.exp(log_scale)), shift
        return self
