"""Experiments that are small enough to hold: their fits are tasks spread over the cluster.

An experiment is held as its samples' features if these are few numbers, or else, if it has more
features than samples, as a Gram matrix. That matrix is made of frame pairs: a trials-by-trials
block for every two frames that some window holds together, so that all windows, folds, values of C
and permutations share each of them. The blocks are summed over slices of the features: no task sees
all features, and samples are not copied per fit. Both forms have a bound that is checked before anything is
brought together; larger experiments are fitted as sums over the distributed samples (see primal).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import svm

#: Numbers that may be held: features with their samples' keys, entries of all Gram blocks, labels; and cells of one slice of features.
LOCAL, GRAM, LABELS, SLICE = 2_000_000, 9_000_000, 5_000_000, 2_000_000


def columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of samples but their features; arrays of equal length as the rows of a matrix."""
    return {c: np.stack(v.to_numpy()) if v.dtype == object and len(v) and np.ndim(v.iloc[0]) else v.to_numpy() for c, v in pdf.items() if c != "features"}


def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of an Arrow batch of samples; lists, which have equal lengths, as the rows of a matrix."""
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return {n: matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """rows, which the executors keep meanwhile; rows that are kept already stay so afterwards."""
    level = rows.storageLevel
    if level.useMemory or level.useDisk:
        yield rows
        return
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def made_once(rows: DataFrame) -> DataFrame:
    """rows, made now for several readers: written to spark.checkpoint.dir, or without it kept by a local session.

    A cluster without that setting makes them anew for each reader. Spark's cleaner drops what no table refers to.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        return rows.checkpoint()
    return rows.localCheckpoint() if spark.sparkContext.master.startswith("local[") else rows


@dataclass
class Held:
    """keys: columns of all samples, by (window, trial, frame); x or blocks: their features or products."""

    spark: SparkSession
    keys: dict[str, np.ndarray]
    x: np.ndarray | None = None
    blocks: dict[tuple[int, int], np.ndarray] | None = None
    trials: np.ndarray | None = None
    slices: DataFrame | None = None
    last: tuple = field(default=(None, None))

    def __getstate__(self):
        return {**self.__dict__, "spark": None, "slices": None, "last": (None, None)}

    def rows(self, task: dict) -> np.ndarray:
        """The samples of a task's window; all, without windows."""
        if task.get("window") is None:
            return np.arange(len(self.keys["trial"]))
        low, high = np.searchsorted(self.keys["window"], [task["window"], task["window"] + 1])
        return np.arange(low, high)

    def products(self, rows: np.ndarray) -> np.ndarray:
        """XX' + 1 of some samples, put together from the blocks of their frames; kept for the next call."""
        if self.last[0] is not None and np.array_equal(self.last[0], rows):
            return self.last[1]
        at, image = np.searchsorted(self.trials, self.keys["trial"][rows]), self.keys["image"][rows]
        k, groups = np.ones((len(rows), len(rows))), [(int(f), np.flatnonzero(image == f)) for f in np.unique(image)]
        for i, (f, a) in enumerate(groups):
            for g, b in groups[i:]:
                part = self.blocks[f, g][np.ix_(at[a], at[b])]
                k[np.ix_(a, b)] += part
                if f != g:
                    k[np.ix_(b, a)] += part.T
        self.last = (rows, k)
        return k

    def fit(self, estimator, task: dict, on: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The task's coefficients: weights (bias last), or in the Gram form one per sample of its window."""
        if self.x is not None:
            return estimator.fit(self.x[on], y[on], task["c"])
        rows = self.rows(task)
        mine = on[rows]
        a = np.zeros(len(rows))
        a[mine] = estimator.fit_gram(self.products(rows)[np.ix_(mine, mine)], y[on], task["c"])
        return a

    def scores(self, task: dict, model: np.ndarray, test: np.ndarray) -> np.ndarray:
        if self.x is not None:
            return svm.decide(self.x[test], model)
        rows = self.rows(task)
        return self.products(rows)[test[rows]] @ model

    def each(self, tasks: list, run: Callable, schema: str) -> DataFrame:
        """The rows that run(held, number, task) gives for each task, tasks being spread over the executors in order."""
        held = self

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = [part for t in pdf["id"] if len(part := run(held, t, tasks[t]))]
                if out:
                    yield pd.concat(out)

        parts = min(len(tasks), 2 * self.spark.sparkContext.defaultParallelism)
        return self.spark.range(0, len(tasks), 1, max(1, parts)).mapInPandas(work, schema)

    def weights(self, tasks: list, models: list[np.ndarray]) -> DataFrame:
        """(task, feature, w) of each task's number; feature -1 is the bias.

        In the Gram form w = X'a is summed where the slices of the features are.
        """
        names = "task int, feature int, w double"
        if self.x is not None:
            d = self.x.shape[1]
            rows = pd.DataFrame({"task": np.repeat(np.arange(len(tasks)), d + 1), "feature": np.tile([*range(d), -1], len(tasks)), "w": np.concatenate(models)})
            return self.spark.createDataFrame(rows, names)
        places = [self.rows(t) for t in tasks]
        images = pd.MultiIndex.from_arrays([self.keys["trial"], self.keys["image"]])
        numbers, known = images.factorize()
        of, used = {k: i for i, k in enumerate(known)}, [numbers[p] for p in places]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros((len(of), len(pdf["part"].iloc[0])))
            at = np.array([of.get(k, -1) for k in zip(pdf["trial"], pdf["image"], strict=True)])
            x[at[at >= 0]] = np.stack(pdf["part"].to_numpy())[at >= 0]
            w = np.stack([a @ x[u] for a, u in zip(models, used, strict=True)])
            first = int(pdf["first"].iloc[0])
            return pd.DataFrame({"task": np.repeat(np.arange(len(w)), w.shape[1]), "feature": np.tile(np.arange(first, first + w.shape[1]), len(w)), "w": w.ravel()})

        bias = self.spark.createDataFrame([(i, -1, float(a.sum())) for i, a in enumerate(models)], names)
        return self.slices.groupBy("first").applyInPandas(run, names).union(bias)


def _sliced(images: DataFrame, width: int, step: int) -> DataFrame:
    """(first, trial, image, part): features of each image in slices, `first` being the number of a slice's first one."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step)), lambda i: F.struct(i.alias("first"), F.slice("features", i + 1, F.lit(step)).alias("part")))
    return images.select("trial", "image", F.explode(parts).alias("p")).select("p.first", "trial", "image", "p.part")


def frame_pairs(slices: DataFrame, trials: np.ndarray, pairs: list[tuple[int, int]]) -> DataFrame:
    """(f, g, block): sums over the features of products of any two trials, one in image f and one in image g.

    A group has one slice of the features of all images; partial blocks then pass, sorted by pair, through a
    sum that holds one block at a time.
    """
    n = len(trials)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        at, number, values = np.searchsorted(trials, pdf["trial"]), pdf["image"].to_numpy(), np.stack(pdf["part"].to_numpy()).astype(float)
        image = {f: np.zeros((n, values.shape[1])) for f in np.unique(number).tolist()}
        for f, m in image.items():
            m[at[number == f]] = values[number == f]
        rows = [(f, g, (image[f] @ image[g].T).tobytes()) for f, g in pairs if f in image and g in image]
        return pd.DataFrame(rows, columns=["f", "g", "block"])

    def added(batches):
        pair, total = None, None
        for batch in batches:
            for f, g, block in zip(batch["f"].to_pylist(), batch["g"].to_pylist(), batch["block"], strict=True):
                part = np.frombuffer(block.as_buffer())
                if (f, g) == pair:
                    total += part
                    continue
                if pair:
                    yield _row(pair, total)
                pair, total = (f, g), part.copy()
        if pair:
            yield _row(pair, total)

    def _row(pair, total):
        return pa.RecordBatch.from_arrays([pa.array([pair[0]], pa.int32()), pa.array([pair[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["f", "g", "block"])

    parts = slices.groupBy("first").applyInPandas(partial, "f int, g int, block binary")
    return parts.repartition("f", "g").sortWithinPartitions("f", "g").mapInArrow(added, "f int, g int, block binary")


def hold(placed: DataFrame) -> Held | None:
    """The experiment of samples `placed` (features and keys, in windows if it has that column), or None if it is too large.

    Samples without windows form one window; ys holds labels under permutations. An error if a sample repeats or features
    differ in number. The samples are made once: the executors keep them until they have been measured and read.
    """
    with kept(placed) as rows:
        return _hold(rows)


def _hold(placed: DataFrame) -> Held | None:
    windowed = ["window"] if "window" in placed.columns else []
    size = F.size("features")
    seen = placed.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("d"), F.count_distinct("trial").alias("trials"), F.max("frame").alias("top"), (F.max(F.size("ys")) if "ys" in placed.columns else F.lit(1)).alias("labels"), F.count_distinct(*windowed or [F.lit(0)]).alias("windows")).first()
    if not seen.n:
        raise ValueError("there are no samples")
    if seen.low != seen.d:
        raise ValueError("samples differ in their number of features")
    if seen.n * seen.labels > LABELS:
        return None
    # of samples with few features keys and labels weigh more: whole numbers of half a feature's width, and bytes
    width = seen.d + (len(placed.columns) - 1) / 2 + (seen.labels / 8 if "ys" in placed.columns else 0)
    narrow = seen.n * width <= LOCAL and seen.d * seen.windows <= seen.n
    if not narrow and seen.trials**2 > GRAM:
        return None
    order = [*windowed, "trial", "frame"]
    if not narrow:
        if windowed and _differ(placed):  # averages of windows, for example: no image is shared
            placed = placed.withColumn("image", (F.col("window") * (seen.top + 1) + F.col("frame")).cast("int"))
        else:
            placed = placed.withColumn("image", F.col("frame").cast("int"))
        spans = [tuple(r.f) for r in placed.groupBy(*windowed).agg(F.array_sort(F.collect_set("image")).alias("f")).select("f").distinct().collect()]
        pairs = sorted({(f, g) for images in spans for i, f in enumerate(images) for g in images[i:]})
        if len(pairs) * seen.trials**2 > GRAM:
            return None
    keys = placed.select(*[c for c in placed.columns if narrow or c != "features"]).toArrow().to_pandas().sort_values(order, kind="stable", ignore_index=True)
    if keys.duplicated(order).any():
        raise RuntimeError("a sample repeats: the folds do not test every sample exactly once")
    spark = placed.sparkSession
    if narrow:
        return Held(spark, columns(keys), np.stack(keys["features"].to_numpy()).astype(float))
    keys, trials = columns(keys), np.unique(keys["trial"].to_numpy())
    step = max(1, min(seen.d, 512, SLICE // (seen.trials * len({f for f, _ in pairs}))))
    images = placed.select("trial", "image", "features").dropDuplicates(["trial", "image"])
    slices = _sliced(images, seen.d, step)
    blocks = {(r.f, r.g): np.frombuffer(r.block).reshape(len(trials), len(trials)) for r in frame_pairs(slices, trials, pairs).toLocalIterator()}
    return Held(spark, keys, None, blocks, trials, slices)


def _differ(placed: DataFrame) -> bool:
    """Whether a trial's frame has other features in one window than in another."""
    h = F.xxhash64("features")
    return placed.groupBy("trial", "frame").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").first() is not None
