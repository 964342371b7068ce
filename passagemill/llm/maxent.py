"""Maximum-entropy models of two classes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

RIDGE, NEWTON_STEPS = 1.0, 12


def fit(x: np.ndarray, y: np.ndarray, prior: dict[int, float] | None = None, ridge: float = RIDGE) -> np.ndarray:
    """Weights by Newton's method, drawn to ``prior`` (0 where it says nothing) by a Gaussian."""
    mean = np.array([(prior or {}).get(j, 0.0) for j in range(x.shape[1])])
    sign = 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (x @ w)).sum() + ridge / 2 * ((w - mean) ** 2).sum())

    w, now = mean.copy(), loss(mean)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * (w - mean)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        while loss(w + step) > now and np.abs(step).max() > 1e-6:
            step /= 2
        w = w + step
        now = loss(w)
    return w


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of some rows at ``w`` in one vector, without the prior; those of all rows are sums."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.concatenate([[np.logaddexp(0, (1 - 2 * y) * z).sum()], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def fit_over(slopes_at: Callable[[np.ndarray], np.ndarray], width: int, prior: dict[int, float] | None = None, ridge: float = RIDGE) -> np.ndarray:
    """``fit`` over rows that lie elsewhere: ``slopes_at`` gives the sum of their ``slopes``."""
    mean = np.array([(prior or {}).get(j, 0.0) for j in range(width)])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = slopes_at(w)
        loss = float(s[0] + ridge / 2 * ((w - mean) ** 2).sum())
        return loss, s[1 : width + 1] - ridge * (w - mean), s[width + 1 :].reshape(width, width) + ridge * np.eye(width)

    w, (now, g, h) = mean, at(mean)
    for _ in range(NEWTON_STEPS):
        step = np.linalg.solve(h, g)
        found = at(w + step)
        while found[0] > now and np.abs(step).max() > 1e-6:
            step = step / 2
            found = at(w + step)
        w, (now, g, h) = w + step, found
        if np.abs(step).max() <= 1e-6:
            break
    return w
