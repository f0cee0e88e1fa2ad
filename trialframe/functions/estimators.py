"""Linear two-class estimators for decoding: what fits a task, from features, a Gram matrix or distributed sums.

An estimator has fit(x, y, c) and fit_gram(k, y, c), with k = XX' + 1, for experiments that are held, and
fit_tasks(samples, tasks, sides, costs) for larger ones. Labels are 0 and 1, weights end with the bias.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from . import svm


class Estimator(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray: ...

    def fit_gram(self, k: np.ndarray, y: np.ndarray, c: float) -> np.ndarray: ...

    def fit_tasks(self, samples: DataFrame, tasks: list, sides: Callable, costs: list[float]) -> np.ndarray: ...


class LinearSVM:
    """Squared hinge with a regularised bias (see svm)."""

    def fit(self, x, y, c):
        return svm.fit(x, y, c)

    def fit_gram(self, k, y, c):
        return svm.fit_gram(k, y, c)

    def fit_tasks(self, samples, tasks, sides, costs):
        from ..operators import primal

        return primal.fit_tasks(samples, tasks, sides, costs)[0]


class Ridge:
    """Least squares on labels of -1 and 1: minimises (|w|^2 + b^2) / 2 + c * sum (w.x + b - y)^2."""

    def fit(self, x, y, c):
        if x.shape[1] >= len(x):
            a = self.fit_gram(x @ x.T + 1, y, c)
            return np.r_[x.T @ a, a.sum()]
        x1 = np.c_[x, np.ones(len(x))]
        return np.linalg.solve(np.eye(x1.shape[1]) + 2 * c * x1.T @ x1, 2 * c * x1.T @ np.where(y > 0, 1.0, -1.0))

    def fit_gram(self, k, y, c):
        return np.linalg.solve(k + np.eye(len(k)) / (2 * c), np.where(y > 0, 1.0, -1.0))

    def fit_tasks(self, samples, tasks, sides, costs):
        """One scan: each partition adds X'X and X'y up for all tasks; a task is solved where its sums meet."""
        from ..operators import primal
        from ..operators.held import arrays

        def partial(batches):
            total = None
            for batch in batches:
                known = arrays(batch)
                x = primal.design(known.pop("features"))
                total = np.zeros((len(tasks), x.shape[1], x.shape[1] + 1)) if total is None else total
                for t, task in enumerate(tasks):
                    on, y = sides(known, task)
                    total[t] += x[on].T @ np.c_[x[on], np.where(y[on] > 0, 1.0, -1.0)]
            if total is not None:
                yield from ((t, w.ravel()) for t, w in enumerate(total))

        def solved(t, total):
            d = int(len(total) ** 0.5)
            w, c = total.reshape(d, d + 1), costs[t]
            return np.linalg.solve(np.eye(d) + 2 * c * w[:, :d], 2 * c * w[:, d])

        found = primal.totals(samples, partial, solved)
        return np.stack([found[t] for t in range(len(tasks))])


LINEAR_SVM = LinearSVM()
