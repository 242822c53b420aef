"""Gradient-boosted trees for two classes on a dense feature matrix, small enough to train on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees of fixed depth as arrays: node k has children 2k+1 and 2k+2, the last level holds the values."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss; each split is the best of at most ``bins`` quantile cuts of each feature."""
    mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    above = [(x[:, j, None] > c[None, :]) for j, c in enumerate(cuts)]
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(2**depth - 1):
            at = np.flatnonzero(node == k)
            if len(at) > 1:
                gs, hs = g[at], h[at]
                whole = gs.sum() ** 2 / (hs.sum() + ridge)
                best = 1e-6
                for j, side in enumerate(above):
                    s = side[at]
                    gr, hr = gs @ s, hs @ s
                    gain = gr**2 / (hr + ridge) + (gs.sum() - gr) ** 2 / (hs.sum() - hr + ridge) - whole
                    i = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[i] > best:
                        best, feature[k], cut[k] = float(gain[i]), j, cuts[j][i]
            node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
        margin += value[leaf]
    return model


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities (Platt)."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((target - p) * margin).sum(), (target - p).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)
