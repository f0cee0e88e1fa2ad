"""Group-disjoint splits: trials to folds, and checks of splits."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import ranked


def modulo_folds(trials: DataFrame, n_splits: int) -> DataFrame:
    """(trial, fold): rank of the trial modulo n_splits. One row per trial is ranked, not per sample."""
    return ranked(trials.select("trial").distinct(), "trial", "fold").withColumn("fold", (F.col("fold") % n_splits).cast("int"))


#: Distinct sizes up to which the plan of greedy_folds is broadcast, and up to which the driver makes one.
BROADCAST_SIZES, MOST_SIZES = 10_000, 2_000_000


def _greedy_plan(classes: list[tuple[int, int]], n_splits: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, phases) with sizes descending; a phase is (first rank, folds in turn).

    Folds within a size of the lightest take one trial each, in the order of their loads, before any takes a
    second. Such turns repeat unchanged until the lightest fold comes within a size of one that was heavier,
    which begins a phase: n_splits phases at most, however many trials.
    """
    load, plan = [0] * n_splits, []
    for size, count in sorted(classes, reverse=True):
        at, phases = 0, []
        while at < count:
            low = min(load)
            cycle = sorted((f for f in range(n_splits) if load[f] - low < size), key=lambda f: (load[f], f)) or [load.index(low)]
            heavier = [x for f, x in enumerate(load) if f not in cycle] if size > 0 else []
            ranks = min(count - at, (min(heavier) - low) // size * len(cycle)) if heavier else count - at
            phases.append((at, cycle))
            turns, rest = divmod(ranks, len(cycle))
            for i, f in enumerate(cycle):
                load[f] += size * (turns + (i < rest))
            at += ranks
        plan.append((size, phases))
    return plan


def greedy_folds(sizes: DataFrame, n_splits: int) -> DataFrame:
    """(trial, fold): trials by size descending, ties by id, each into the fold that is lightest so far.

    sizes(trial, n) holds one row per trial. Only the number of trials of each size decides how a size
    is dealt out (see _greedy_plan); a trial's fold follows from its rank within its size. The driver sees a
    row per distinct size; more than MOST_SIZES of them are an error.
    """
    counts = sizes.groupBy("n").count().limit(MOST_SIZES + 1).collect()
    if len(counts) > MOST_SIZES:
        raise ValueError(f"greedy folds take {MOST_SIZES} distinct sizes at most")
    plan = sizes.sparkSession.createDataFrame(_greedy_plan([(int(r[0]), int(r[1])) for r in counts], n_splits), "size long, phases array<struct<first: long, cycle: array<int>>>")
    plan = F.broadcast(plan) if len(counts) <= BROADCAST_SIZES else plan
    rows = ranked(sizes.select("trial", F.col("n").cast("long").alias("n")), "trial", "_rank", ("n",)).join(plan, F.col("n") == F.col("size"))
    rows = rows.withColumn("_phase", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("_rank")), -1))
    fold = F.get("_phase.cycle", ((F.col("_rank") - F.col("_phase.first")) % F.size("_phase.cycle")).cast("int"))
    return rows.select(F.col("trial").cast("long").alias("trial"), fold.alias("fold"))


def splits(trials: DataFrame, splitter: Callable[[DataFrame], DataFrame] | DataFrame | Iterable) -> DataFrame:
    """(trial, fold) of any splitter, checked: a function of trials(trial, y), a fold table, or (train, test) pairs of ids.

    An error if there is no fold, a fold names a trial that trials does not have, a trial is tested twice, or a
    side is empty. Of a pair, train has to be all trials but those of test. Trials in no fold are never tested; decoding,
    which tests every sample once, refuses them.
    """
    found = splitter(trials) if callable(splitter) else splitter
    if not isinstance(found, DataFrame):
        pairs = [(set(train), set(test)) for train, test in found]
        everyone = set().union(*(a | b for a, b in pairs))
        if any(a & b or a | b != everyone for a, b in pairs):
            raise ValueError("training and test side of a split overlap, or leave trials out")
        if pairs and trials.select("trial").distinct().count() != len(everyone):
            raise ValueError("training and test side of a split overlap, or leave trials out")
        found = trials.sparkSession.createDataFrame([(int(t), k) for k, (_, test) in enumerate(pairs) for t in sorted(test)], "trial long, fold int")
    found = found.select(F.col("trial").cast("long").alias("trial"), F.col("fold").cast("int").alias("fold"))
    known = trials.select(F.col("trial").cast("long").alias("trial"), F.lit(1).alias("known")).distinct()
    seen = found.join(known, "trial", "left").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"), F.count_distinct("trial").alias("trials"), F.count_distinct("fold").alias("folds")).first()
    if not seen.folds:
        raise ValueError("a splitter gives at least one fold")
    if seen.known < seen.n:
        raise ValueError("a fold has a trial that is not there")
    if seen.trials < seen.n:
        raise ValueError("a trial is tested twice")
    if found.groupBy("fold").count().where(F.col("count") == known.count()).first():
        raise ValueError("a fold leaves nothing to train on")
    return found


def coverage(tested: DataFrame) -> DataFrame:
    """Times that each sample is tested: samples per count. Full coverage is the single row (1, all)."""
    return tested.groupBy("sample_id").agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("samples"))


def bad_splits(samples: DataFrame, folds: DataFrame, n_splits: int) -> DataFrame:
    """Folds of 0..n_splits-1 with an empty test or training side."""
    n = samples.join(folds, "trial").groupBy("fold").agg(F.count(F.lit(1)).alias("test"))
    total = samples.select(F.count(F.lit(1)).alias("total"))
    grid = samples.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("fold"))
    out = grid.join(n, "fold", "left").crossJoin(F.broadcast(total)).withColumn("test", F.coalesce("test", F.lit(0)))
    return out.where((F.col("test") == 0) | (F.col("test") == F.col("total"))).select("fold", "test")


def impure_groups(samples: DataFrame) -> DataFrame:
    """Trials whose samples disagree on the label."""
    return samples.groupBy("trial").agg(F.countDistinct("y").alias("labels")).where("labels > 1")


def require_labels(samples: DataFrame, trials: DataFrame) -> None:
    """An error unless each trial's samples agree on the label and trials(trial, y) names each trial once, with it."""
    if impure_groups(samples).limit(1).count():
        raise ValueError("labels differ within a trial")
    if trials.count() != trials.select("trial").distinct().count():
        raise ValueError("a trial has several labels")
    first = samples.select("trial", F.col("y").alias("_y")).distinct()
    both = first.join(trials.select("trial", "y"), "trial", "full").where("y is null or _y is null or y <> _y")
    if both.limit(1).count():
        raise ValueError("trials and samples do not match")


def shuffle_key(seed: str, *columns: str) -> Column:
    """A reproducible random order: md5 of seed and ids, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def leave_pair_out(trials: DataFrame, seed: str = "0") -> DataFrame:
    """(trial, fold): a shuffled positive and a shuffled negative trial in each fold; unpaired ones in none."""
    ranked = trials.withColumn("fold", F.row_number().over(W.partitionBy("y").orderBy(shuffle_key(seed, "trial"))) - 1)
    paired = ranked.groupBy("fold").agg(F.countDistinct("y").alias("k")).where("k = 2").select("fold")
    return ranked.join(paired, "fold").select("trial", "y", "fold")


def split_matrix(trials: DataFrame, folds: DataFrame, n_splits: int) -> DataFrame:
    """(fold, trial, in_test) for every fold and trial: the picture of a split."""
    grid = folds.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return trials.join(grid, "trial").select(F.col("at").alias("fold"), "trial", (F.col("fold") == F.col("at")).cast("int").alias("in_test"))
