"""Linear SVM fits of many tasks at once, as sums over a distributed table of samples.

The objective is that of functions.svm. A Newton step needs only sums over the samples: the loss, its
gradient and its Hessian on the active set. Every partition adds these up for all tasks, a task of its own adds
the partitions' sums of one fit and solves for its step, and the driver, which sees neither samples nor Hessians,
chooses the step's length. So a fit reads the samples about ten times and never brings them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.svm import TOLERANCE
from .held import arrays, kept

#: Shorter steps tried at once where a whole one fails, numbers that a partition adds up at most, and rounds.
LENGTHS, CELLS, ROUNDS = (0.5, 0.25, 0.125, 0.0625), 10_000_000, 200
#: Up to this many features products of pairs are made once for all tasks of a side; tasks that share arrays; partitions of a scan at least.
NARROW, SHARED, PARTS = 24, 64, 8


def design(features: np.ndarray) -> np.ndarray:
    """Samples as rows, a column of ones last."""
    return np.c_[features.astype(float), np.ones(len(features))]


def totals(samples: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], finish: Callable[[int, np.ndarray], np.ndarray] = lambda _, x: x) -> dict[int, np.ndarray]:
    """finish(number, sum) of the arrays that partial gives for each partition, summed by number.

    As many partitions are scanned at once as there are cores, so that what is summed does not grow with the input.
    """
    schema = "number int, sums binary"

    def row(number: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["number", "sums"])

    def scan(batches):
        for number, sums in partial(b for b in batches if b.num_rows):
            yield row(number, sums)

    def added(batches):
        last, total = None, None
        for batch in batches:
            for number, block in zip(batch["number"].to_pylist(), batch["sums"], strict=True):
                part = np.frombuffer(block.as_buffer())
                if number == last:
                    total += part
                    continue
                if last is not None:
                    yield row(last, finish(last, total))
                last, total = number, part.copy()
        if last is not None:
            yield row(last, finish(last, total))

    parts = samples.coalesce(max(PARTS, samples.sparkSession.sparkContext.defaultParallelism)).mapInArrow(scan, schema)
    rows = parts.repartition("number").sortWithinPartitions("number").mapInArrow(added, schema)
    return {r.number: np.frombuffer(r.sums) for r in rows.collect()}


def _by_side(tasks: list[dict], chosen: list[int]) -> list[list[int]]:
    """Places in `chosen`, a list of tasks, of those with the same training samples: they differ in C and permutation only."""
    groups: dict[tuple, list[int]] = {}
    for e, t in enumerate(chosen):
        groups.setdefault(tuple((k, tasks[t].get(k)) for k in ("window", "fold", "at", "inner")), []).append(e)
    return [g[i : i + SHARED] for g in groups.values() for i in range(0, len(g), SHARED)]


def _sums(samples: DataFrame, tasks: list, sides: Callable, costs: np.ndarray, chosen: list[int], points: np.ndarray, curved: np.ndarray) -> dict[int, np.ndarray]:
    """For each point, which belongs to the task of that place in `chosen`: value, gradient and, if curved, the Newton step there."""
    n, d = points.shape
    groups, upper = _by_side(tasks, chosen), np.triu_indices(d)
    narrow = d <= NARROW + 1

    def partial(batches):
        loss, slope = np.zeros(n), np.zeros((n, d))
        square = np.zeros((n, len(upper[0]))) if narrow else {e: np.zeros((d, d)) for e in np.flatnonzero(curved).tolist()}
        for batch in batches:
            known = arrays(batch)
            x = design(known.pop("features"))
            fine = np.isfinite(x).all(1)
            for group in groups:
                on = sides(known, tasks[chosen[group[0]]])[0] & fine
                xs = x[on]
                if not len(xs):
                    continue
                labels = {t: np.where(sides(known, tasks[t])[1][on] > 0, 1.0, -1.0) for t in {chosen[e] for e in group}}
                s = np.stack([labels[chosen[e]] for e in group], 1)
                slack = np.maximum(0, 1 - s * (xs @ points[group].T))
                loss[group] += np.einsum("ij,ij->j", slack, slack)
                slope[group] += (s * slack).T @ xs
                if narrow:
                    square[group] += (slack > 0).astype(float).T @ (xs[:, upper[0]] * xs[:, upper[1]])
                    continue
                whole = None
                for i, e in enumerate(group):
                    if e not in square:
                        continue
                    active = slack[:, i] > 0
                    if 2 * active.sum() <= len(xs):
                        part = xs[active]
                        square[e] += part.T @ part
                    else:  # the products of all samples serve every task of the side
                        whole = xs.T @ xs if whole is None else whole
                        part = xs[~active]
                        square[e] += whole - part.T @ part
        for e in range(n):
            yield e, np.r_[loss[e], slope[e], (square[e] if narrow else square[e][upper]) if curved[e] else ()]

    def finish(e, total):
        c, p = costs[chosen[e]], points[e]
        g = p - 2 * c * total[1 : 1 + d]
        if not curved[e]:
            return np.r_[p @ p / 2 + c * total[0], g]
        h = np.zeros((d, d))
        h[upper] = 2 * c * total[1 + d :]
        h = h + np.triu(h, 1).T + np.eye(d)
        return np.r_[p @ p / 2 + c * total[0], g, np.linalg.solve(h, g)]

    return totals(samples, partial, finish)


def _fit(samples: DataFrame, tasks: list, sides: Callable, costs: np.ndarray, d: int):
    """A whole step is tried first, with the Hessian at its end, then shorter ones; at the end of one of these the Hessian takes another round."""
    n = len(tasks)
    v, step, gradient = np.zeros((n, d)), np.zeros((n, d)), np.zeros((n, d))
    value, slope, limit = np.full(n, np.inf), np.zeros(n), np.zeros(n)
    size, unknown = np.zeros(n), np.ones(n, bool)  # lengths of 0, where the step is not known yet
    open_ = list(range(n))
    for _ in range(ROUNDS):
        lengths = {t: np.array([size[t]]) if size[t] in (0, 1) else size[t] * np.array(LENGTHS) / LENGTHS[0] for t in open_}
        chosen = [t for t in open_ for _ in lengths[t]]
        tried = np.concatenate([lengths[t] for t in open_])
        points = v[chosen] - tried[:, None] * step[chosen]
        curved = (tried == 0) | (tried == 1) | (d <= NARROW + 1)
        sums = _sums(samples, tasks, sides, costs, chosen, points, curved)
        left, at = [], 0
        for t in open_:
            mine, at = range(at, at + len(lengths[t])), at + len(lengths[t])
            good = [e for e in mine if unknown[t] or sums[e][0] <= value[t] - 1e-4 * tried[e] * slope[t]]
            if good:
                e = good[0]
                v[t], value[t], gradient[t] = points[e], sums[e][0], sums[e][1 : 1 + d]
                limit[t] = limit[t] or max(TOLERANCE * max(1.0, costs[t]), 1e-12 * np.abs(gradient[t]).max())
                if np.abs(gradient[t]).max() <= limit[t]:
                    continue
                unknown[t], size[t] = not curved[e], float(curved[e])
                if curved[e]:
                    step[t] = sums[e][1 + d :]
                    slope[t] = gradient[t] @ step[t]
            elif np.abs(gradient[t]).max() <= 100 * limit[t]:
                continue  # rounding hides what is left
            elif size[t] < 1e-9:
                raise RuntimeError("the SVM fit did not converge")
            else:
                size[t] = tried[mine[-1]] * LENGTHS[0]
            left.append(t)
        open_ = left
        if not open_:
            return v, gradient
    raise RuntimeError("the SVM fit did not converge")


def fit_tasks(samples: DataFrame, tasks: list, sides: Callable, costs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bias last) and final gradients of all tasks, in their order.

    sides(columns, task) gives which rows of a batch train the task, and the labels of all its rows. Tasks
    go in groups, so that a partition's sums stay below CELLS numbers. The samples are kept by the executors
    meanwhile; lost parts are computed anew.
    """
    with kept(samples) as rows:
        first = rows.selectExpr("size(features) as n").first()
        if first is None:
            raise ValueError("there are no samples")
        d = first.n + 1
        group = max(1, CELLS // (1 + d + d * d))
        parts = [_fit(rows, tasks[i : i + group], sides, np.array(costs[i : i + group]), d) for i in range(0, len(tasks), group)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
