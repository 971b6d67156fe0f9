"""Gradient-boosted trees for a logistic loss over a few binned features: small, and trained on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Booster:
    """Trees of equal depth: for each inner node a feature and a bound (right if above), for each leaf a value."""

    depth: int = 3
    bias: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, bound, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, penalty: float = 1.0) -> Booster:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Booster(depth, float(np.log(share / (1 - share))))
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins))) for k in range(x.shape[1])]
    margin = np.full(len(x), model.bias)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, bound = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(x), int)
        for at in range(inner):
            own = node == at
            if own.any():
                feature[at], bound[at] = _best_split(x[own], g[own], h[own], bounds, penalty)
            node[own] = 2 * at + 1 + (x[own, feature[at]] > bound[at])
        leaf_of = node - inner
        total_g, total_h = (np.bincount(leaf_of, v, 2**depth) for v in (g, h))
        leaf = -rate * total_g / (total_h + penalty)
        model.trees.append((feature, bound, leaf))
        margin = margin + leaf[leaf_of]
    return model


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, bounds: list[np.ndarray], penalty: float) -> tuple[int, float]:
    best, choice, whole = 1e-9, (0, np.inf), g.sum() ** 2 / (h.sum() + penalty)
    for k, cuts in enumerate(bounds):
        at = np.searchsorted(cuts, x[:, k])
        left_g, left_h = (np.cumsum(np.bincount(at, v, len(cuts) + 1))[:-1] for v in (g, h))
        gain = left_g**2 / (left_h + penalty) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + penalty) - whole
        if len(gain) and gain.max() > best:
            best, choice = gain.max(), (k, float(cuts[gain.argmax()]))
    return choice
