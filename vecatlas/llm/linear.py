"""Small numpy classifiers: logistic regression over sparse or dense rows, and calibration of scores."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights with the bias last; full-batch Adam on the weighted log loss."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = np.ones(len(x)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (weight * (sigmoid(x @ w) - y)) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a score into log odds; the slope is never negative."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    spread = max(float(score.std()), 1e-9)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = logistic((score / spread)[:, None], target, l2=1e-6, steps=400)
    return max(w[0] / spread, 0.0), w[1]


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a positive has the higher score, ties half."""
    values, at = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(at, weights=y, minlength=len(values)), np.bincount(at, weights=1 - y, minlength=len(values))
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / max(pos.sum() * neg.sum(), 1e-12))
