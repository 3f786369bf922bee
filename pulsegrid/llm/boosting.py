"""Boosted trees over yes/no features, fitted on a table of counts.

Rows with the same features are one entry of the table, so its size is bounded by the number of
feature patterns, however many rows were counted: Spark counts, the driver fits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tree(NamedTuple):
    """Two levels: by ``root``, then by ``low`` or ``high``; ``leaves`` for 00, 01, 10, 11."""

    root: int
    low: int
    high: int
    leaves: tuple[float, float, float, float]


class Model(NamedTuple):
    start: float
    trees: tuple[Tree, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for t in self.trees:
            second = np.where(x[:, t.root], x[:, t.high], x[:, t.low]).astype(int)
            total += np.asarray(t.leaves)[2 * x[:, t.root].astype(int) + second]
        return total

    def column(self, bits: Column) -> Column:
        """The raw score of features packed in ``bits`` (feature f is bit f)."""
        has = lambda f: bits.bitwiseAND(1 << f) != 0
        total = F.lit(self.start)
        for t in self.trees:
            a, b, c, d = (F.lit(v) for v in t.leaves)
            total = total + F.when(has(t.root), F.when(has(t.high), d).otherwise(c)).otherwise(F.when(has(t.low), b).otherwise(a))
        return total


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0) -> Model:
    """Logistic boosting: each round takes the two-level tree of the greatest gain (Newton leaves)."""
    n = positive + negative
    start = float(np.log((positive.sum() + 0.5) / (negative.sum() + 0.5)))
    raw, trees = np.full(len(x), start), []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = positive - n * p, n * p * (1 - p)

        def best(rows: np.ndarray) -> tuple[float, int]:
            g, h, f = grad[rows], hess[rows], x[rows]
            g1, h1 = g @ f, h @ f
            g0, h0 = g.sum() - g1, h.sum() - h1
            gain = g1 ** 2 / (h1 + ridge) + g0 ** 2 / (h0 + ridge)
            at = int(np.argmax(gain))
            return float(gain[at]), at

        choices = []
        for root in range(x.shape[1]):
            high = x[:, root].astype(bool)
            (gain_low, low), (gain_high, high_f) = best(~high), best(high)
            choices.append((gain_low + gain_high, -root, low, high_f))
        _, root, low, high = max(choices)
        root = -root
        leaf = 2 * x[:, root].astype(int) + np.where(x[:, root], x[:, high], x[:, low]).astype(int)
        g, h = np.bincount(leaf, grad, 4), np.bincount(leaf, hess, 4)
        leaves = rate * g / (h + ridge)
        trees.append(Tree(root, low, high, tuple(map(float, leaves))))
        raw = raw + leaves[leaf]
    return Model(start, tuple(trees))


def threshold(raw: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float) -> float:
    """The lowest score from which on at least ``precision`` of the counted rows are positive (infinite: none).

    It lies half-way to the next lower score that was counted, so that patterns close to the
    selected ones, but not counted here, are judged by the nearer side.
    """
    best, seen_p, seen_n = float("inf"), 0.0, 0.0
    for s in sorted(set(raw.tolist()), reverse=True):
        here = raw == s
        seen_p, seen_n = seen_p + positive[here].sum(), seen_n + negative[here].sum()
        if seen_p > 0 and seen_p >= precision * (seen_p + seen_n):
            best = s
    lower = raw[raw < best]
    return float((best + lower.max()) / 2) if np.isfinite(best) and len(lower) else best
