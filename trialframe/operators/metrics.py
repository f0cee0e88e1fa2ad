"""Metrics of predictions: votes, accuracies, confusion counts, ROC, fold summaries, histograms.

Predictions have the columns trial, frame, fold, y_true, y_pred, score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import is_finite, skip_nan
from .ranking import ranges, running_sums
from .validation import require


def _hit() -> Column:
    return F.avg((F.col("y_pred") == F.col("y_true")).cast("double"))


def majority_vote(predictions: DataFrame, keys: tuple = ("fold", "trial")) -> DataFrame:
    """One prediction per trial: the most frequent label, ties to the smallest; the truth is the first sample's."""
    return predictions.groupBy(*keys).agg(F.mode("y_pred", True).alias("y_pred"), F.min_by("y_true", "frame").alias("y_true"))


def accuracy(predictions: DataFrame, keys: tuple = ("fold",)) -> DataFrame:
    return predictions.groupBy(*keys).agg(_hit().alias("acc"), F.count(F.lit(1)).alias("n_test"))


def trial_accuracy(predictions: DataFrame, keys: tuple = ("fold",)) -> DataFrame:
    return accuracy(majority_vote(predictions, (*keys, "trial")), keys)


def confusion(predictions: DataFrame, labels: tuple = (0, 1)) -> DataFrame:
    """Counts of the full label grid, zero where nothing falls."""
    grid = predictions.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "y_true int, y_pred int")
    counts = predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def roc_auc(predictions: DataFrame, keys: tuple = ()) -> DataFrame:
    """Rank form of the area under the curve with mean ranks of ties; one class only gives null.

    Equal scores are counted first, so the running sum goes over distinct scores, range by range.
    """
    scored = predictions.where(is_finite(F.col("score")))
    by_score = scored.groupBy(*keys, "score").agg(F.sum("y_true").alias("pos"), F.count(F.lit(1)).alias("n"))
    by_score = running_sums(by_score, "score", {"below": F.col("n")}, keys)
    ranks = by_score.withColumn("rank_sum", F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0))
    sums = ranks.groupBy(*keys).agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * (F.col("n") - F.col("p"))).cast("double"))
    return sums.select(*keys, area.alias("auc"))


def roc_curve(predictions: DataFrame, strict: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score from the highest down, after the point (null, 0, 0).

    With one class only its other rate is null; strict: that fails the query.
    """
    by_score = predictions.where(is_finite(F.col("score"))).groupBy("score").agg(F.sum("y_true").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(by_score.agg(F.sum("pos").alias("p_all"), F.sum("n").alias("n_all")))  # one row
    below = running_sums(by_score, "score", {"p_below": F.col("pos"), "n_below": F.col("n")}).crossJoin(whole)
    if strict:
        both = (F.col("p_all") > 0) & (F.col("p_all") < F.col("n_all"))
        below = below.withColumn("score", require(F.col("score"), both, "a ROC curve needs both classes"))
    tp, seen = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    points = below.select(F.col("score").alias("threshold"), F.try_divide(seen - tp, F.col("n_all") - F.col("p_all")).alias("fpr"), F.try_divide(tp, F.col("p_all")).alias("tpr"))
    return points.unionByName(predictions.sparkSession.createDataFrame([(None, 0.0, 0.0)], points.schema))


def curve_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area below a ROC curve.

    fpr + tpr rises along the curve; steps are taken within ranges of it, and from the last point of a
    range to the first of the next.
    """
    points = curve.select("fpr", "tpr", (F.col("fpr") + F.col("tpr")).alias("k"))
    points = points.withColumn("_range", ranges(points, "k"))
    before = lambda c, w: F.lag(c).over(w)
    trapeze = lambda x, y, x0, y0: (x - x0) * (y + y0) / 2
    w = W.partitionBy("_range").orderBy("k", "fpr")
    inner = points.select(trapeze(F.col("fpr"), F.col("tpr"), before("fpr", w), before("tpr", w)).alias("a"))
    key, point = F.struct("k", "fpr"), F.struct("fpr", "tpr")
    ends = points.groupBy("_range").agg(F.min_by(point, key).alias("lo"), F.max_by(point, key).alias("hi"))
    last = F.lag("hi").over(W.orderBy("_range"))  # a row per range
    ends = ends.select("lo", last.alias("last")).select(trapeze(F.col("lo.fpr"), F.col("lo.tpr"), F.col("last.fpr"), F.col("last.tpr")).alias("a"))
    return inner.union(ends).agg(F.sum("a").alias("auc"))


def sem(table: DataFrame, column: str, keys: tuple = ()) -> DataFrame:
    """Sample deviation over the root of the count, NaN left out; null for one value."""
    x = skip_nan(F.col(column))
    return table.groupBy(*keys).agg((F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Per fold: frame accuracy, area under the curve, voted accuracy, samples."""
    frames = accuracy(predictions)
    return frames.join(roc_auc(predictions, ("fold",)), "fold", "left").join(trial_accuracy(predictions).select("fold", F.col("acc").alias("acc_trial")), "fold")


def fold_summary(folds: DataFrame, keys: tuple = ()) -> DataFrame:
    """Means and sample deviations over folds; missing areas are left out, missing accuracies are not."""
    out = []
    for c in ("acc", "auc", "acc_trial"):
        x = skip_nan(F.col(c)) if c == "auc" else F.col(c)
        out += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
    return folds.groupBy(*keys).agg(*out)


def out_of_fold(samples: DataFrame, predictions: DataFrame, strict: bool = False) -> DataFrame:
    """Every sample with its held-out prediction; null where it was never tested.

    strict: a sample without prediction, or a prediction of no sample, fails the query.
    """
    tested = predictions.select("trial", "frame", "fold", "y_pred", "score")
    if not strict:
        return samples.join(tested, ["trial", "frame"], "left")
    both = samples.withColumn("_sample", F.lit(1)).join(tested.withColumn("_tested", F.lit(1)), ["trial", "frame"], "full")
    aligned = F.col("_sample").isNotNull() & F.col("_tested").isNotNull()
    return both.withColumn("fold", require(F.col("fold"), aligned, "samples and predictions are not aligned")).drop("_sample", "_tested")


def histogram(table: DataFrame, column: str, bins: int = 30, strict: bool = False) -> DataFrame:
    """(bin, low, high, n) of equal-width bins from minimum to maximum, the last one closed.

    Without finite values the ends of the bins are null; strict: that fails the query.
    """
    if bins < 1:
        raise ValueError("a histogram has one bin at least")
    rows = table.where(is_finite(F.col(column)))
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    if strict:
        ends = ends.withColumn("lo", require(F.col("lo"), F.col("lo").isNotNull(), "no value is finite"))
    placed = rows.crossJoin(F.broadcast(ends))  # one row
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def peak(curve: DataFrame, column: str = "acc", at: str = "center") -> DataFrame:
    """The largest value and where it is; the first of equal ones."""
    key = F.struct(F.col(column), -F.col(at))
    return curve.where(is_finite(F.col(column))).agg(F.max(column).alias("peak"), F.max_by(at, key).alias("at"))


def select_c(grid: DataFrame, rule: str = "one_se", tie_break: str = "smaller", keys: tuple = ()) -> DataFrame:
    """The chosen C from grid(c, fold, metric): the smallest or largest C within a tolerance of the best mean.

    one_se: the standard error of the best C (sample deviation over the root of its folds); best: the
    smallest finite standard error on the grid. The first of equal means is the best.
    Means are compared after rounding to 12 places, so that equal shares count as equal.
    """
    if rule not in ("one_se", "best") or tie_break not in ("smaller", "larger"):
        raise ValueError("rule is one_se or best, tie_break smaller or larger")
    by_c = grid.groupBy(*keys, "c").agg(F.avg("metric").alias("mean"), (F.stddev_samp("metric") / F.sqrt(F.count("metric"))).alias("se"))
    w = W.partitionBy(*keys or [F.lit(0)])
    best_se = F.max_by("se", F.struct("mean", -F.col("c"))).over(w) if rule == "one_se" else F.min("se").over(w)
    near = by_c.select("*", F.max("mean").over(w).alias("best"), F.coalesce(best_se, F.lit(0.0)).alias("tolerance")).where("round(mean, 12) >= round(best - tolerance, 12)")
    pick = F.min("c") if tie_break == "smaller" else F.max("c")
    return near.groupBy(*keys).agg(pick.alias("c"))


def final_c(chosen: DataFrame, rule: str = "mode_then_median") -> DataFrame:
    """One C from the folds' choices: the median of the most frequent ones, the median, or the smallest mode."""
    if rule == "median":
        return chosen.agg(F.median("c").alias("c"))
    counts = chosen.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.withColumn("most", F.max("n").over(W.partitionBy(F.lit(0)))).where("n = most")
    return modes.agg((F.median("c") if rule == "mode_then_median" else F.min("c")).alias("c"))
