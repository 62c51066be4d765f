"""Small logistic regressions with a Gaussian prior, on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, prior: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one the bias, that maximise likelihood times prior (Newton's method)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    mean = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, dtype=float)
    w = mean.copy()
    pull = np.full(x.shape[1], strength)
    pull[-1] = 0.01
    case = np.ones(len(x)) if weight is None else weight

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((case * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + 0.5 * (pull * (v - mean) ** 2).sum())

    now = loss(w)
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (case * (p - y)) + pull * (w - mean)
        hessian = (x * (case * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-9 * (1 + abs(now)):
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
