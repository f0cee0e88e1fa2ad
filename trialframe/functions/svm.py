"""The linear SVM fit of one group of samples, in NumPy: squared hinge, L2, regularised bias.

Minimises (|w|^2 + b^2) / 2 + C * sum(max(0, 1 - y (w.x + b))^2), which is strictly convex, so the
gradient certifies the optimum.
"""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-8


def gradient(v: np.ndarray, x1: np.ndarray, s: np.ndarray, c: float) -> np.ndarray:
    """Gradient at v for samples x1 (a column of ones last) and labels s of -1 and 1."""
    slack = np.maximum(0, 1 - s * (x1 @ v))
    return v - 2 * c * x1.T @ (s * slack)


def _value(v, x1, s, c) -> float:
    return v @ v / 2 + c * (np.maximum(0, 1 - s * (x1 @ v)) ** 2).sum()


def fit_primal(x: np.ndarray, y: np.ndarray, c: float, most: int = 200) -> np.ndarray:
    """Weights and bias by Newton steps over the active samples, with a line search; for features <= samples."""
    x1, s = np.c_[x, np.ones(len(x))], np.where(y > 0, 1.0, -1.0)
    v = np.zeros(x1.shape[1])
    for _ in range(most):
        g = gradient(v, x1, s, c)
        if np.abs(g).max() <= TOLERANCE * max(1.0, c):
            return v
        active = x1[s * (x1 @ v) < 1]
        step = np.linalg.solve(np.eye(len(v)) + 2 * c * active.T @ active, g)
        size, now = 1.0, _value(v, x1, s, c)
        while size > 1e-10 and _value(v - size * step, x1, s, c) > now - 1e-4 * size * (g @ step):
            size /= 2
        v = v - size * step
    if np.abs(gradient(v, x1, s, c)).max() > 1e-6 * max(1.0, c):
        raise RuntimeError("the SVM fit did not converge")
    return v


def fit_gram(k: np.ndarray, y: np.ndarray, c: float, most: int = 200) -> np.ndarray:
    """Sample coefficients a, with w = X'a and b = sum(a), from the Gram matrix k = XX' + 1 alone.

    On the active set I, a solves (K_II + 1/(2C)) a = y_I; for more features than samples. The same
    matrix serves all permutations of the labels.
    """
    s, a = np.where(y > 0, 1.0, -1.0), np.zeros(len(y))
    value = lambda a: a @ k @ a / 2 + c * (np.maximum(0, 1 - s * (k @ a)) ** 2).sum()
    for _ in range(most):
        slack = np.maximum(0, 1 - s * (k @ a))
        if np.abs(a - 2 * c * s * slack).max() <= TOLERANCE * max(1.0, c):
            return a
        on = slack > 0
        new = np.zeros(len(y))
        new[on] = np.linalg.solve(k[np.ix_(on, on)] + np.eye(on.sum()) / (2 * c), s[on])
        size, now = 1.0, value(a)
        while size > 1e-10 and value(a + size * (new - a)) > now:
            size /= 2
        a = a + size * (new - a)
    if np.abs(a - 2 * c * s * np.maximum(0, 1 - s * (k @ a))).max() > 1e-6 * max(1.0, c):
        raise RuntimeError("the SVM fit did not converge")
    return a


def fit(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """Weights and bias; the primal form if there are no more features than samples."""
    if x.shape[1] <= len(x):
        return fit_primal(x, y, c)
    try:
        a = fit_gram(x @ x.T + 1, y, c)
    except (RuntimeError, np.linalg.LinAlgError):
        return fit_primal(x, y, c)
    return np.r_[x.T @ a, a.sum()]


def decide(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores; the label is 1 where they are above 0."""
    return x @ v[:-1] + v[-1]
