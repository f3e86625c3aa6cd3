"""Gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: ``feature`` and ``cut`` per inner node, ``value`` per leaf; ``base`` for all."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 2.0, seed: int = 1) -> Trees:
    """Boost ``trees`` trees on the logistic loss; a split minimises it over quantile bins of half the features."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    table = np.full((width, bins), np.inf, np.float32)
    code = np.zeros((n, width), np.int64)
    for f, c in enumerate(cuts):
        table[f, : len(c)] = c
        code[:, f] = np.searchsorted(c, x[:, f], "left")
    varied = np.flatnonzero(code.max(axis=0) > 0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        chosen = rng.choice(varied, max(1, len(varied) // 2), replace=False) if len(varied) else varied
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain, best_cut, best_feature = np.zeros(count), np.full(count, np.inf), np.zeros(count, np.int64)
            for f in chosen:
                slot = (at - first) * (bins + 1) + code[:, f]
                g = np.bincount(slot, slope, count * (bins + 1)).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(slot, bend, count * (bins + 1)).reshape(count, -1).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                won = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
                top = won[:, :bins].argmax(axis=1)
                value_here = won[np.arange(count), top]
                better = value_here > gain + 1e-9
                gain[better], best_feature[better], best_cut[better] = value_here[better], f, table[f, top[better]]
            feature[t, first : first + count], cut[t, first : first + count] = best_feature, best_cut
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        value[t] = rate * g / (h + ridge)
        margin += value[t, leaf]
    return Trees(feature, cut, value, base)
