"""Logistic regression by Newton's steps, for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: np.ndarray | float, steps: int = 25) -> np.ndarray:
    """Coefficients of least weighted logistic loss plus l2 times their squares. No intercept of its own."""
    w = np.zeros(x.shape[1])
    penalty = np.broadcast_to(np.asarray(l2, float), w.shape)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
