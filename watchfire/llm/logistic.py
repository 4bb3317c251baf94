"""Calibration: a small logistic regression on a few features, fitted on the driver."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept first, for features as given) by Newton steps on the penalised log-likelihood.

    With one class only, or no rows, the features get no weight and the intercept says the class's rate (a row of each
    class added).
    """
    n, k = x.shape
    rate = (y.sum() + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return np.array([np.log(rate / (1 - rate)), *[0.0] * k])
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(n), (x - mean) / sd])
    w = np.zeros(k + 1)
    w[0] = np.log(rate / (1 - rate))
    penalty = np.diag([1e-9, *[ridge * n] * k])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty @ w
        h = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(k + 1)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    out = w.copy()
    out[1:] /= sd
    out[0] -= (w[1:] * mean / sd).sum()
    return out


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
