"""A small logistic regression for tables whose size doesn't depend on the corpus (vote patterns, bounded samples)."""

from __future__ import annotations

import numpy as np


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients for soft labels y in [0, 1], by Newton's method; x holds a column of ones where a constant is wanted."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
