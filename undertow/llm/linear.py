"""Sparse logistic regression over hashed binary features, fitted on the driver from a bounded sample of rows."""

from __future__ import annotations

import numpy as np

#: Buckets of hashed features; a model is this many numbers, a fixed size that tasks can carry.
BUCKETS = 1 << 18
#: Slopes below this take proportionally small steps, so that features of few rows don't take over.
FLOOR = 0.03


class Sparse:
    """Binary rows as concatenated feature lists."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate(rows).astype(np.int64) if rows and self.lengths.sum() else np.array([], np.int64)
        self.rows = np.repeat(np.arange(len(rows)), self.lengths)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], len(self.lengths))

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, r[self.rows], size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Problem:
    """Weighted log loss of labelled rows, and the mean squared difference of the scores of paired rows."""

    def __init__(
        self,
        rows: list[np.ndarray],
        target: np.ndarray,
        weight: np.ndarray,
        pairs: tuple[list[np.ndarray], list[np.ndarray]] | None,
        pair_penalty: float,
    ) -> None:
        self.used = np.unique(np.concatenate([np.zeros(0, np.int64), *rows, *(pairs[0] + pairs[1] if pairs else [])]).astype(np.int64))
        place = lambda many: Sparse([np.searchsorted(self.used, r) for r in many])
        self.x, self.target, self.weight = place(rows), target, weight / max(weight.sum(), 1e-300)
        self.pairs = (place(pairs[0]), place(pairs[1])) if pairs and pairs[0] and pair_penalty else None
        self.pair_penalty = pair_penalty

    def loss(self, w: np.ndarray, bias: float) -> float:
        z = self.x.dot(w) + bias
        found = (self.weight * (np.logaddexp(0, z) - self.target * z)).sum()
        if self.pairs:
            found += self.pair_penalty * ((self.pairs[0].dot(w) - self.pairs[1].dot(w)) ** 2).mean()
        return float(found)

    def slope(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        error, n = self.weight * (sigmoid(self.x.dot(w) + bias) - self.target), len(self.used)
        found = self.x.back(error, n)
        if self.pairs:
            one, other = self.pairs
            gap = 2 * self.pair_penalty * (one.dot(w) - other.dot(w)) / len(one.lengths)
            found += one.back(gap, n) - other.back(gap, n)
        return found, float(error.sum())


def fit(
    rows: list[np.ndarray],
    target: np.ndarray,
    weight: np.ndarray,
    pairs: tuple[list[np.ndarray], list[np.ndarray]] | None = None,
    l1: float = 4e-4,
    pair_penalty: float = 1.0,
    steps: int = 200,
    rate: float = 0.3,
    unlearned: float = 0.0,
) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal AdaGrad on weighted log loss, an L1 penalty on the weights, and pair_penalty times the
    mean squared difference of the scores of paired rows (a counterfactual pair should score alike). unlearned is the bias
    where there are no rows."""
    if not len(rows):
        return np.zeros(BUCKETS), unlearned
    problem = Problem(rows, target, weight, pairs, pair_penalty)
    n = len(problem.used)
    w, seen, seen_bias = np.zeros(n), np.full(n, FLOOR**2), 1e-8
    base = float(np.clip((problem.weight * target).sum(), 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    for _ in range(steps):
        slope, slope_bias = problem.slope(w, bias)
        seen += slope**2
        seen_bias += slope_bias**2
        step = rate / np.sqrt(seen)
        w = w - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= 0.3 * rate * slope_bias / np.sqrt(seen_bias)
    full = np.zeros(BUCKETS)
    full[problem.used] = w
    return full, bias
