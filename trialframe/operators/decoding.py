"""Linear decoding under group-disjoint cross-validation.

A fit is a task: the fold it leaves out, C, and the window or permutation it belongs to. Experiments that
are small enough are held (see held), as features or as a Gram matrix of frame pairs, and their tasks
spread over the executors; of larger ones all fits run at once as sums over the distributed samples (see
primal), which are never grouped. Both reach the same optimum. Folds, votes, summaries and choices of C are
DataFrame operations on the fits' small results. The estimator is a parameter (see functions.estimators).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.estimators import LINEAR_SVM, Estimator
from ..functions.svm import gradient as svm_gradient
from . import features, held, metrics, primal, significance
from .held import Held
from .ranking import running_sums

#: The usual grid: 7 values from 1e-4 to 1e2.
C_GRID = tuple(10.0**k for k in range(-4, 3))
NOT_ONCE = "the folds do not test every sample exactly once"
#: Columns of samples that decoding needs; others are not carried along.
SAMPLE = ("window", "center", "trial", "frame", "y", "features")
PREDICTIONS = "trial long, frame int, fold int, y_true int, y_pred int, score double"


def _distinct(table: DataFrame, column: str) -> list:
    """The values of a column that names folds, windows or permutations: as many as the experiment has."""
    return sorted(r[0] for r in table.select(column).distinct().collect())


def _two_classes(y: np.ndarray, what: str = "a permuted fold") -> None:
    if not len(y) or (y == y[0]).all():
        raise ValueError(f"{what} has an empty side or one training class")


def _check_folds(placed: DataFrame, keys: tuple = ()) -> None:
    """An error if a fold has no test samples or fewer than two training classes."""
    counts = pd.DataFrame([tuple(r) for r in placed.groupBy(*keys, "fold", "y").count().collect()], columns=[*keys, "fold", "y", "n"])
    for _, part in counts.groupby(list(keys)) if keys else [((), counts)]:
        for k in part["fold"].unique():
            if part.loc[part["fold"] != k, "y"].nunique() < 2:
                raise ValueError(f"fold {k} has an empty side or one training class")


def _check_held(known: dict) -> None:
    """The checks of _experiment on the driver's copy of the keys."""
    if np.isnan(known["fold"].astype(float)).any():
        raise RuntimeError(NOT_ONCE)
    known["fold"] = known["fold"].astype(np.int32)
    windows = known.get("window", np.zeros(len(known["fold"])))
    for w in np.unique(windows):
        fold, y = known["fold"][windows == w], known["y"][windows == w]
        for k in np.unique(fold):
            _two_classes(y[fold != k], f"fold {k}")


def _inner_held(known: dict, folds: list, inner_splits: int) -> np.ndarray:
    """The inner fold of each sample for each outer fold in order: its trial's rank in that training set, dealt in turn."""
    inner = np.full((len(known["fold"]), len(folds)), -1, np.int8 if inner_splits < 128 else int)
    for i, k in enumerate(folds):
        train = known["fold"] != k
        names = np.unique(known["trial"][train])
        inner[train, i] = np.searchsorted(names, known["trial"][train]) % inner_splits
        for j in range(min(inner_splits, len(names))):
            _two_classes(known["y"][train & (inner[:, i] != j)], f"inner fold {j}")
    return inner


def _inner_placed(placed: DataFrame, outer: DataFrame, folds: list, inner_splits: int) -> DataFrame:
    """_inner_held as a column of distributed samples."""
    ranks = running_sums(outer.select("trial", "fold"), "trial", {f"_in{i}": (F.col("fold") != k).cast("long") for i, k in enumerate(folds)})
    inner = F.array(*[(F.col(f"_in{i}") % inner_splits).cast("int") for i in range(len(folds))])
    placed = placed.join(ranks.select("trial", inner.alias("inner")), "trial")
    sides = placed.select("y", F.posexplode("inner").alias("at", "i"), F.col("fold").alias("own"))
    sides = sides.join(F.broadcast(placed.sparkSession.createDataFrame(list(enumerate(folds)), "at int, o int")), "at").where("own <> o")
    _check_folds(sides.select("at", F.col("i").alias("fold"), "y"), ("at",))
    return placed


@contextmanager
def _experiment(samples: DataFrame, fold_of: DataFrame, inner_splits: int = 0, labels: DataFrame | None = None) -> Iterator[tuple[Held | DataFrame, list, list]]:
    """The experiment of samples with their trial's fold, held or distributed, its folds, and its permutations.

    With inner_splits, samples have `inner`, with labels(perm, trial, y_perm), `ys` in the order of the permutations. An error
    unless each sample is tested exactly once, and each training side has two classes. Distributed samples are made
    once and kept by the executors until the block ends; a trial's samples stand together, sorted, in one partition.
    """
    with ExitStack() as stack:
        keep = lambda rows: stack.enter_context(held.kept(rows))
        fold_of = keep(fold_of.select("trial", "fold"))
        placed, perms = samples.select(*[c for c in samples.columns if c in SAMPLE]).join(fold_of, "trial", "left"), []
        if labels is not None:
            ordered = F.array_sort(F.collect_list(F.struct("perm", F.col("y_perm").cast("tinyint").alias("y")))).alias("ys")
            by_trial = keep(labels.groupBy("trial").agg(ordered).select("trial", F.col("ys.perm").alias("perms"), F.col("ys.y").alias("ys")))
            perms = list((by_trial.select("perms").first() or [[]])[0])
            placed = placed.join(by_trial.select("trial", "ys"), "trial")
        with held.kept(placed) as first:
            data = held.hold(first)
            if data is None:
                seen = first.agg(F.count(F.lit(1)).alias("n"), F.count("fold").alias("tested")).first()
                if seen.n != seen.tested or fold_of.groupBy("trial").count().where("count > 1").first():
                    raise RuntimeError(NOT_ONCE)
                folds = _distinct(fold_of, "fold")
                rows = _inner_placed(first, fold_of, folds, inner_splits) if inner_splits else first
                windowed = ("window",) if "window" in rows.columns else ()
                spark = rows.sparkSession
                parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
                data = keep(rows.repartition(parts, "trial").sortWithinPartitions(*windowed, "trial"))
                _check_folds(data, windowed)  # which makes them
        if isinstance(data, Held):
            _check_held(data.keys)
            folds = np.unique(data.keys["fold"]).tolist()
            if inner_splits:
                data.keys["inner"] = _inner_held(data.keys, folds, inner_splits)
        yield data, folds, perms


def _whole_trials(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of batches of distributed samples, cut so that each trial's samples of a window come together."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        last = np.ones(rest.num_rows, bool)
        for c in {"window", "trial"} & set(rest.schema.names):
            last &= (v := rest[c].to_numpy(zero_copy_only=False)) == v[-1]
        cut = rest.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield held.arrays(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None:
        yield held.arrays(rest)


def _left_out(known: dict, task: dict) -> tuple[np.ndarray, np.ndarray]:
    """Training samples and labels of a task: its window, without its fold, under its permutation."""
    on = known["fold"] != task.get("fold", -1)
    if task.get("window") is not None:
        on &= known["window"] == task["window"]
    if task.get("inner") is not None:
        on &= known["inner"][:, task["at"]] != task["inner"]
    return on, known["y"] if task.get("perm") is None else known["ys"][:, task["perm"]]


def _tested(known: dict, task: dict) -> np.ndarray:
    """The samples that a task leaves out to test on."""
    if task.get("inner") is not None:
        return (known["fold"] != task["fold"]) & (known["inner"][:, task["at"]] == task["inner"])
    test = known["fold"] == task["fold"]
    return test if task.get("window") is None else test & (known["window"] == task["window"])


def _models(data: Held | DataFrame, tasks: list[dict], estimator: Estimator) -> list[np.ndarray]:
    """Coefficients of all tasks, as the driver's copy of small results."""
    if not isinstance(data, Held):
        return list(estimator.fit_tasks(data, tasks, _left_out, [t["c"] for t in tasks]))

    def run(h: Held, number: int, task: dict) -> pd.DataFrame:
        on, y = _left_out(h.keys, task)
        _two_classes(y[on])
        return pd.DataFrame({"id": [number], "a": [h.fit(estimator, task, on, y)]})

    found = {r.id: np.array(r.a) for r in data.each(tasks, run, "id int, a array<double>").collect()}
    return [found[i] for i in range(len(tasks))]


def _predicted(data: Held | DataFrame, tasks: list[dict], models: list[np.ndarray], extra: str = "") -> DataFrame:
    """Predictions of the samples that each task left out; `extra` names further columns, of the task or the sample."""
    more = [c.split()[0] for c in extra.split(",") if c]

    def rows(known: dict, task: dict, test: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        y = _left_out(known, task)[1][test].astype(int)
        out = {"trial": known["trial"][test], "frame": known["frame"][test], "fold": task["fold"], "y_true": y, "y_pred": (score > 0).astype(int), "score": score}
        return pd.DataFrame(out | {c: task[c] if c in task else known[c][test] for c in more})

    schema = PREDICTIONS + (", " + extra if extra else "")
    if isinstance(data, Held):

        def one(h: Held, number: int, task: dict) -> pd.DataFrame:
            test = _tested(h.keys, task)
            return rows(h.keys, task, test, h.scores(task, models[number], test))

        return data.each(tasks, one, schema)

    def run(frames):
        for pdf in frames:
            if len(pdf):
                x, known = primal.design(np.stack(pdf["features"].to_numpy())), held.columns(pdf)
                for task, v in zip(tasks, models, strict=True):
                    test = _tested(known, task)
                    yield rows(known, task, test, x[test] @ v)

    return data.mapInPandas(run, schema)


def cross_validate(samples: DataFrame, fold_of: DataFrame, c: float, estimator: Estimator = LINEAR_SVM) -> DataFrame:
    """Out-of-fold predictions of samples(trial, frame, y, features): one fit per fold.

    An error if a fold has an empty side or one training class, or a sample is not tested exactly once.
    """
    with _experiment(samples, fold_of) as (data, folds, _):
        tasks = [{"fold": k, "c": c} for k in folds]
        return _predicted(data, tasks, _models(data, tasks, estimator))


def _weight_rows(data: Held | DataFrame, tasks: list[dict], models: list[np.ndarray]) -> DataFrame:
    """(task, feature, w); feature -1 is the bias."""
    if isinstance(data, Held):
        return data.weights(tasks, models)
    rows = [(i, j if j < len(v) - 1 else -1, float(w)) for i, v in enumerate(models) for j, w in enumerate(v)]
    return data.sparkSession.createDataFrame(rows, "task int, feature int, w double")


def _named(rows: DataFrame, tasks: list[dict], names: list[str]) -> DataFrame:
    """Rows of tasks with the tasks' parameters in place of their numbers."""
    known = rows.sparkSession.createDataFrame([(i, *[int(t[c]) for c in names]) for i, t in enumerate(tasks)], "task int, " + ", ".join(f"{c} int" for c in names))
    return rows.join(F.broadcast(known), "task").select(*names, *[c for c in rows.columns if c != "task"])


def fold_weights(samples: DataFrame, fold_of: DataFrame, c: float, estimator: Estimator = LINEAR_SVM) -> DataFrame:
    """(fold, feature, w) of the fit that leaves each fold out; feature -1 is the bias."""
    with _experiment(samples, fold_of) as (data, folds, _):
        tasks = [{"fold": k, "c": c} for k in folds]
        return _named(_weight_rows(data, tasks, _models(data, tasks, estimator)), tasks, ["fold"])


def final_model(samples: DataFrame, c: float) -> DataFrame:
    """(feature, w, gradient) of the SVM fit to all samples; the gradient's entries certify the optimum."""
    placed = samples.withColumn("fold", F.lit(0))
    task = {"c": c}
    with held.kept(placed) as rows:
        data = held.hold(rows)
        if data is None:
            v, g = primal.fit_tasks(rows, [task], _left_out, [c])
    if data is None:
        rows = [(i if i < len(v[0]) - 1 else -1, float(w), float(x)) for i, (w, x) in enumerate(zip(v[0], g[0], strict=True))]
        return samples.sparkSession.createDataFrame(rows, "feature int, w double, gradient double")
    model, sign = _models(data, [task], LINEAR_SVM)[0], np.where(data.keys["y"] > 0, 1.0, -1.0)
    everyone = np.ones(len(sign), bool)
    if data.x is not None:
        slope = svm_gradient(model, np.c_[data.x, everyone], sign, c)
    else:  # the gradient, too, is a sum of samples
        slope = model - 2 * c * sign * np.maximum(0, 1 - sign * data.scores(task, model, everyone))
    both = data.weights([task, task], [model, slope])
    return both.groupBy("feature").agg(F.max(F.when(F.col("task") == 0, F.col("w"))).alias("w"), F.max(F.when(F.col("task") == 1, F.col("w"))).alias("gradient"))


def _inner_metrics(data: Held | DataFrame, folds: list, inner_splits: int, grid: tuple, metric: str, perms: list | None, estimator: Estimator) -> DataFrame:
    """(perm, outer, c, fold, metric) of all inner folds; perm is -1 without permuted labels."""
    tasks = [
        {"fold": k, "at": i, "inner": j, "c": float(c), "perm": p}
        for p in perms or [None] for i, k in enumerate(folds) for c in grid for j in range(inner_splits)
    ]
    keys = ("perm", "outer", "c", "fold")
    if isinstance(data, Held):

        def one(h: Held, number: int, t: dict) -> pd.DataFrame:
            (on, y), test = _left_out(h.keys, t), _tested(h.keys, t)
            if not test.any():  # fewer training trials than inner folds
                return pd.DataFrame()
            _two_classes(y[on])
            score = h.scores(t, h.fit(estimator, t, on, y), test)
            value = ((score > 0) == (y[test] > 0)).mean() if metric == "acc" else _auc(score, y[test])
            return pd.DataFrame({"perm": [-1 if t["perm"] is None else t["perm"]], "outer": t["fold"], "c": t["c"], "fold": t["inner"], "metric": None if np.isnan(value) else value})

        # fits are made once: the choice of C reads their few results several times
        rows = data.each(tasks, one, "perm int, outer int, c double, fold int, metric double")
        return data.spark.createDataFrame(rows.toArrow())
    models = _models(data, tasks, estimator)
    if metric == "acc":

        def hits(batches):
            counts = np.zeros((len(tasks), 2))
            for batch in batches:
                known = held.arrays(batch)
                x = primal.design(known.pop("features"))
                for i, (t, v) in enumerate(zip(tasks, models, strict=True)):
                    test = _tested(known, t)
                    if test.any():
                        counts[i] += ((x[test] @ v > 0) == (_left_out(known, t)[1][test] > 0)).sum(), test.sum()
            yield from enumerate(counts)

        found = primal.totals(data, hits)
        values = [(-1 if t["perm"] is None else t["perm"], t["fold"], t["c"], t["inner"], float(found[i][0] / found[i][1])) for i, t in enumerate(tasks) if found[i][1]]
        return data.sparkSession.createDataFrame(values, "perm int, outer int, c double, fold int, metric double")
    names = [*keys, "score", "y_true"]

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x, known = primal.design(np.stack(pdf["features"].to_numpy())), held.columns(pdf)
            for t, v in zip(tasks, models, strict=True):
                test = _tested(known, t)
                score, y = x[test] @ v, _left_out(known, t)[1][test]
                yield pd.DataFrame({"perm": -1 if t["perm"] is None else t["perm"], "outer": t["fold"], "c": t["c"], "fold": t["inner"], "score": score, "y_true": y})[names]

    rows = data.mapInPandas(run, "perm int, outer int, c double, fold int, score double, y_true int")
    areas = metrics.roc_auc(rows, keys).withColumnRenamed("auc", "metric")
    return data.sparkSession.createDataFrame(areas.toArrow())  # a row per fit, read several times


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    n1 = int((y > 0).sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return float("nan")
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    return float((rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def _check_choice(grid: tuple, metric: str) -> None:
    if metric not in ("acc", "auc") or not grid:
        raise ValueError("metric is acc or auc, the grid not empty")


def inner_scores(samples: DataFrame, outer: DataFrame, inner_splits: int, grid: tuple = C_GRID, metric: str = "acc", estimator: Estimator = LINEAR_SVM) -> DataFrame:
    """(outer, c, fold, metric) of the inner folds in each outer training set."""
    _check_choice(grid, metric)
    with _experiment(samples, outer, inner_splits) as (data, folds, _):
        return _inner_metrics(data, folds, inner_splits, grid, metric, None, estimator).drop("perm")


def _chosen(scores: DataFrame, rule: str = "one_se", tie_break: str = "smaller", perms: tuple = ()) -> list[dict]:
    """The outer tasks with the C that their inner folds choose."""
    inner = scores.withColumnRenamed("fold", "inner").withColumnRenamed("outer", "fold")
    rows = metrics.select_c(inner, rule, tie_break, (*perms, "fold")).orderBy(*perms, "fold").collect()
    return [{k: r[k] for k in (*perms, "fold", "c")} for r in rows]


def nested_run(
    samples: DataFrame, outer: DataFrame, inner_splits: int = 4, grid: tuple = C_GRID, metric: str = "acc", rule: str = "one_se", tie_break: str = "smaller",
    estimator: Estimator = LINEAR_SVM,
) -> tuple[DataFrame, DataFrame]:
    """Predictions (with the fold's C) of the outer folds, and (fold, feature, w) of their fits.

    C is chosen inside each training set. Two steps instead of nested loops: all inner fits of all outer folds and
    C, then all outer fits; both share what the experiment is held as.
    """
    _check_choice(grid, metric)
    with _experiment(samples, outer, inner_splits) as (data, folds, _):
        tasks = _chosen(_inner_metrics(data, folds, inner_splits, grid, metric, None, estimator), rule, tie_break)
        models = _models(data, tasks, estimator)
        return held.made_once(_predicted(data, tasks, models, "c double")), _named(_weight_rows(data, tasks, models), tasks, ["fold"])


def nested(samples: DataFrame, outer: DataFrame, *args, **options) -> DataFrame:
    """The predictions of nested_run."""
    return nested_run(samples, outer, *args, **options)[0]


def nested_record(samples: DataFrame, outer: DataFrame, *args, **options) -> dict[str, DataFrame]:
    """All tables of a nested run: predictions, folds, weights of each outer fit, trials out of fold, confusion, summary.

    An error if the folds do not test every sample exactly once.
    """
    predictions, weights = nested_run(samples, outer, *args, **options)
    trials = metrics.majority_vote(predictions)
    return {
        "predictions": predictions, "folds": metrics.fold_metrics(predictions), "weights": weights, "trials": trials,
        "confusion": metrics.confusion(trials), "summary": nested_summary(predictions),
    }


def nested_summary(predictions: DataFrame) -> DataFrame:
    """Means and deviations over outer folds, and the final C."""
    choice = metrics.final_c(predictions.select("fold", "c").distinct()).select(F.col("c").alias("final_c"))
    return metrics.fold_summary(metrics.fold_metrics(predictions)).crossJoin(F.broadcast(choice))


def window_samples(cube: DataFrame, size: int, first: int, last: int, step: int = 1) -> DataFrame:
    """Samples of every sliding window: window, center, trial, frame, y, features.

    Images are put together once per frame; then each appears in the windows that cover it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pixel", "value")))
    images = cube.where((F.col("frame") >= first) & (F.col("frame") < last + size)).groupBy("trial", "frame", "y").agg(F.transform(ordered, lambda c: c["value"]).alias("features"))
    return features.sliding_windows(images, size, first, last, step).select("window", "center", "trial", "frame", "y", "features")


def _window_tasks(data: Held | DataFrame, c: float, perms: list | None = None) -> list[dict]:
    if isinstance(data, Held):
        seen = sorted(set(zip(*[data.keys[k].tolist() for k in ("window", "fold", "center")], strict=True)))
    else:
        seen = sorted(tuple(r) for r in data.select("window", "fold", "center").distinct().collect())
    return [{"window": w, "center": m, "fold": k, "perm": p, "c": c} for (w, k, m), p in product(seen, perms or [None])]


def sliding_decode(samples: DataFrame, fold_of: DataFrame, c: float = 1e-4, estimator: Estimator = LINEAR_SVM) -> DataFrame:
    """Predictions per window: window, center and those of cross_validate; all windows and folds at once."""
    with _experiment(samples, fold_of) as (data, _, _):
        tasks = _window_tasks(data, c)
        return _predicted(data, tasks, _models(data, tasks, estimator), "window int, center int")


def sliding_curve(predictions: DataFrame) -> DataFrame:
    """Per window: mean and population deviation over folds of the frame and the voted accuracy."""
    keys = ("window", "center", "fold")
    both = metrics.accuracy(predictions, keys).join(metrics.trial_accuracy(predictions, keys).select(*keys, F.col("acc").alias("acc_trial")), list(keys))
    return both.groupBy("window", "center").agg(
        F.avg("acc").alias("frame_acc"), F.stddev_pop("acc").alias("frame_acc_std"), F.avg("acc_trial").alias("trial_acc"), F.stddev_pop("acc_trial").alias("trial_acc_std")
    )


def sliding_weights(samples: DataFrame, fold_of: DataFrame, c: float = 1e-4, estimator: Estimator = LINEAR_SVM) -> DataFrame:
    """(window, fold, feature, w) of all fits."""
    with _experiment(samples, fold_of) as (data, _, _):
        tasks = _window_tasks(data, c)
        return _named(_weight_rows(data, tasks, _models(data, tasks, estimator)), tasks, ["window", "fold"]).where("feature >= 0")


def sliding_record(samples: DataFrame, fold_of: DataFrame, c: float = 1e-4, estimator: Estimator = LINEAR_SVM) -> dict[str, DataFrame]:
    """All tables of a sliding run: predictions, curve per window, and mean and deviation of each weight per window."""
    with _experiment(samples, fold_of) as (data, _, _):
        tasks = _window_tasks(data, c)
        models = _models(data, tasks, estimator)
        predictions = _predicted(data, tasks, models, "window int, center int")
        w = _named(_weight_rows(data, tasks, models), tasks, ["window", "fold"]).where("feature >= 0")
    means = w.groupBy("window", "feature").agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"))
    return {"predictions": predictions, "curve": sliding_curve(predictions), "weights": means}


def _accuracies(data: Held | DataFrame, tasks: list[dict], keys: tuple, metric: str, estimator: Estimator) -> DataFrame:
    """keys, frame_acc and trial_acc of each task under permuted labels; with metric `auc` frame_acc is the area."""
    if isinstance(data, Held):

        def one(h: Held, number: int, task: dict) -> pd.DataFrame:
            (on, y), test = _left_out(h.keys, task), _tested(h.keys, task)
            _two_classes(y[on])
            score = h.scores(task, h.fit(estimator, task, on, y), test)
            trial, at = np.unique(h.keys["trial"][test], return_inverse=True)
            votes, n = np.bincount(at, score > 0, len(trial)), np.bincount(at, minlength=len(trial))
            truth = np.zeros(len(trial), int)
            truth[at] = y[test]
            frame = ((score > 0) == (y[test] > 0)).mean() if metric == "acc" else _auc(score, y[test])
            return pd.DataFrame({k: [task[k]] for k in keys} | {"frame_acc": frame, "trial_acc": ((2 * votes > n) == (truth > 0)).mean()})

        return data.each(tasks, one, ", ".join(f"{k} int" for k in keys) + ", frame_acc double, trial_acc double")
    models = _models(data, tasks, estimator)
    if metric == "acc":  # counted where the samples are: predictions of all permutations would be many times the samples

        def hits(batches):
            counts = np.zeros((len(tasks), 4))
            for known in _whole_trials(batches):
                x = primal.design(known.pop("features"))
                for i, (task, v) in enumerate(zip(tasks, models, strict=True)):
                    test = _tested(known, task)
                    if not test.any():
                        continue
                    y, positive = _left_out(known, task)[1][test] > 0, x[test] @ v > 0
                    first = np.flatnonzero(np.diff(known["trial"][test], prepend=np.nan))
                    n, votes = np.diff(first, append=len(y)), np.add.reduceat(positive.astype(int), first)
                    counts[i] += (positive == y).sum(), len(y), ((2 * votes > n) == y[first]).sum(), len(first)
            yield from enumerate(counts)

        found = primal.totals(data, hits)
        shares = [(*[int(t[k]) for k in keys], float(found[i][0] / found[i][1]), float(found[i][2] / found[i][3])) for i, t in enumerate(tasks) if found[i][1]]
        return data.sparkSession.createDataFrame(shares, ", ".join(f"{k} int" for k in keys) + ", frame_acc double, trial_acc double")
    extra = ", ".join(f"{k} int" for k in keys if k != "fold")
    predictions = _predicted(data, tasks, models, extra)
    votes = metrics.trial_accuracy(predictions, keys).select(*keys, F.col("acc").alias("trial_acc"))
    frames = metrics.roc_auc(predictions, keys).withColumnRenamed("auc", "frame_acc")
    return frames.select(*keys, "frame_acc").join(votes, list(keys))


def _with_names(rows: DataFrame, perms: list, keys: tuple) -> DataFrame:
    names = rows.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(perms)], "perm int, name int")
    return rows.join(F.broadcast(names), "perm").select(F.col("name").alias("perm"), *keys, "frame_acc", "trial_acc")


def sliding_permutations(samples: DataFrame, fold_of: DataFrame, labels: DataFrame, c: float = 1e-4, estimator: Estimator = LINEAR_SVM) -> DataFrame:
    """(perm, window, fold, frame_acc, trial_acc) under permuted labels(perm, trial, y_perm).

    Labels are joined to the samples by trial. Only they change from permutation to permutation, so all fits
    of a window share its products.
    """
    with _experiment(samples, fold_of, labels=labels) as (data, _, perms):
        tasks = _window_tasks(data, c, list(range(len(perms))))
        out = _accuracies(data, tasks, ("perm", "window", "fold"), "acc", estimator)
        return _with_names(out, perms, ("window", "fold"))


def fixed_permutations(
    samples: DataFrame, outer: DataFrame, labels: DataFrame, inner_splits: int = 4, grid: tuple = C_GRID, metric: str = "acc", estimator: Estimator = LINEAR_SVM
) -> DataFrame:
    """(perm, fold, frame_acc, trial_acc) of nested decoding under permuted labels; with metric `auc`, frame_acc is the area.

    C is chosen inside each training set by the one-standard-error rule.
    """
    _check_choice(grid, metric)
    with _experiment(samples, outer, inner_splits, labels) as (data, folds, perms):
        tasks = _chosen(_inner_metrics(data, folds, inner_splits, grid, metric, list(range(len(perms))), estimator), perms=("perm",))
        return _with_names(_accuracies(data, tasks, ("perm", "fold"), metric, estimator), perms, ("fold",))


def sliding_significance(null: DataFrame, predictions: DataFrame, alpha: float = 0.001) -> DataFrame:
    """Windows of sliding_permutations against the real voted accuracies, two-tailed and adjusted."""
    mean_null = null.groupBy("perm", "window").agg(F.avg("trial_acc").alias("score"))
    real = metrics.trial_accuracy(predictions, ("window", "fold")).groupBy("window").agg(F.avg("acc").alias("score"))
    # a row per window, read several times
    return significance.window_significance(held.made_once(mean_null), held.made_once(real), "two", alpha)


