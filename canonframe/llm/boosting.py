"""Gradient-boosted trees over small binned features, fitted on a contingency table and applied as SQL.

The table has a row for each combination of bins with its weights of both classes, so fitting costs the same whatever
the number of candidates behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    trees: list  # nested: float, or (feature, bin, left, right): left where the feature's bin is at most `bin`

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _apply(t, x)
        return out

    def sql(self, names: list[str]) -> str:
        """The margin as an expression over columns of bins."""
        return " + ".join([f"({self.base!r}D)", *(_sql(t, names) for t in self.trees)])


def _apply(t, x: np.ndarray) -> np.ndarray:
    if isinstance(t, float):
        return np.full(len(x), t)
    f, b, lo, hi = t
    return np.where(x[:, f] <= b, _apply(lo, x), _apply(hi, x))


def _sql(t, names: list[str]) -> str:
    if isinstance(t, float):
        return f"({t!r}D)"
    f, b, lo, hi = t
    return f"(CASE WHEN {names[f]} <= {b} THEN {_sql(lo, names)} ELSE {_sql(hi, names)} END)"


def _tree(x, g, h, depth: int, l2: float, rate: float):
    total_g, total_h = g.sum(), h.sum()
    leaf = float(-rate * total_g / (total_h + l2))
    if depth == 0 or len(x) < 2:
        return leaf
    best, at = 1e-6, None
    for f in range(x.shape[1]):
        top = int(x[:, f].max())
        gs, hs = np.cumsum(np.bincount(x[:, f], g, top + 1)), np.cumsum(np.bincount(x[:, f], h, top + 1))
        for b in range(top):
            gl, hl = gs[b], hs[b]
            gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
            if gain > best:
                best, at = gain, (f, b)
    if at is None:
        return leaf
    f, b = at
    left = x[:, f] <= b
    return (f, b, _tree(x[left], g[left], h[left], depth - 1, l2, rate), _tree(x[~left], g[~left], h[~left], depth - 1, l2, rate))


def fit(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """x: bins (ints from 0) by row and feature; pos, neg: weights of each row's two classes."""
    p0 = (pos.sum() + 0.5) / (pos.sum() + neg.sum() + 1)
    out = Trees(float(np.log(p0 / (1 - p0))), [])
    margin = np.full(len(x), out.base)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        t = _tree(x, p * (pos + neg) - pos, np.maximum(p * (1 - p) * (pos + neg), 1e-12), depth, l2, rate)
        out.trees.append(t)
        margin += _apply(t, x)
    return out


def threshold(margin: np.ndarray, pos: np.ndarray, neg: np.ndarray, precision: float) -> float:
    """The least margin from which on the (held-back) rows reach the precision; infinity if none does."""
    order = np.argsort(-margin, kind="stable")
    p, n = np.cumsum(pos[order]), np.cumsum(neg[order])
    last = np.append(np.diff(margin[order]) != 0, True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((p / np.maximum(p + n, 1e-9) >= precision) & last & (p > 0))
    return float(margin[order][good[-1]]) if len(good) else float("inf")
