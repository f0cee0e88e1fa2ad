"""Weight maps: statistics over folds, images, extreme masks, timecourses of masked pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import is_finite
from .normalize import joined_by, max_abs_scaled
from .ranking import percentiles


def weight_stats(weights: DataFrame, keys: tuple = ()) -> DataFrame:
    """Per pixel of weights(fold, pixel, w): mean, sample deviation, |mean|, sign, mean over largest |mean|."""
    out = weights.groupBy(*keys, "pixel").agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"))
    out = out.withColumn("abs_mean", F.abs("mean")).withColumn("sign", F.signum("mean"))
    return max_abs_scaled(out, "mean", "scaled", list(keys))


def weight_image(weights: DataFrame, pixels: DataFrame) -> DataFrame:
    """Every pixel of the image with its weight, null outside the region."""
    return pixels.join(weights.select("pixel", "w"), "pixel", "left")


def features_to_pixels(vector: DataFrame, roi: DataFrame) -> DataFrame:
    """(pixel, w) from vector(feature, w): the k-th feature is the k-th pixel of the region."""
    order = roi.select("pixel", (F.row_number().over(W.orderBy("pixel")) - 1).alias("feature"))
    return vector.join(order, "feature").select("pixel", "w")


def pixel_time(weights: DataFrame, pixels: DataFrame) -> DataFrame:
    """(pixel, window, w) for every pixel and window of weights(window, pixel, w), null outside the region."""
    windows = weights.agg(F.array_sort(F.collect_set("window")).alias("ws"))
    grid = pixels.crossJoin(F.broadcast(windows)).select("pixel", F.explode("ws").alias("window"))  # one row of window numbers
    return grid.join(weights.select("pixel", "window", "w"), ["pixel", "window"], "left")


def extreme_masks(weights: DataFrame, frac: float, keys: tuple = (), strict: bool = True) -> DataFrame:
    """weights with pos_mask and neg_mask: the top frac of the positive and the bottom frac of the negative weights.

    Thresholds interpolate exactly; no task holds all weights of a key (see percentiles). strict: percentiles
    of each sign alone; otherwise of all weights. A sign without weights has no mask. Weights that are null
    or not finite are in no mask; null keys are a key.
    """
    if not 0 < frac < 1:
        raise ValueError("frac lies between 0 and 1")
    w = F.when(is_finite(F.col("w")), F.col("w"))
    side = "_side"
    # strict: each sign is a key of its own, otherwise all finite weights are one
    values = weights.select(*keys, w.alias("w"), (F.signum(w) if strict else F.lit(0.0)).alias(side)).where(F.col("w").isNotNull() & ((F.col(side) != 0) | F.lit(not strict)))
    cuts = percentiles(values, "w", {"pos_cut": 1 - frac, "neg_cut": frac}, (*keys, side))
    cuts = cuts.groupBy(*keys).agg(F.max(F.when(F.col(side) >= 0, F.col("pos_cut"))).alias("pos_cut"), F.max(F.when(F.col(side) <= 0, F.col("neg_cut"))).alias("neg_cut"))
    joined = joined_by(weights, cuts, list(keys)) if keys else weights.crossJoin(F.broadcast(cuts))  # one row
    mark = lambda sign, cut: F.coalesce((sign if strict else F.lit(True)) & cut, F.lit(False))
    return joined.withColumn("pos_mask", mark(w > 0, w >= F.col("pos_cut"))).withColumn("neg_mask", mark(w < 0, w <= F.col("neg_cut")))


def sign_timecourse(cube: DataFrame, masks: DataFrame, strict: bool = False) -> DataFrame:
    """Mean activation per frame of the pixels in each mask: (sign, frame, mean).

    strict: an empty mask, or masked pixels that the cube lacks, are an error.
    """
    signs = masks.select("pixel", F.explode(F.array(F.when(F.col("pos_mask"), 1), F.when(F.col("neg_mask"), -1))).alias("sign")).where("sign is not null").distinct()
    if strict:
        if signs.select("sign").distinct().count() < 2:
            raise ValueError("a mask has no pixels")
        if signs.join(cube.select("pixel").distinct(), "pixel", "left_anti").limit(1).count():
            raise ValueError("the masks hold pixels that the cube lacks")
    return cube.join(signs, "pixel").groupBy("sign", "frame").agg(F.avg("value").alias("mean"))


def clip_limits(weights: DataFrame, q: float | None = None) -> DataFrame:
    """(low, high), symmetric: the largest |w|, or its q-th percentile, over finite weights."""
    sizes = weights.where(is_finite(F.col("w"))).select(F.abs("w").alias("size"))
    high = sizes.agg(F.max("size").alias("high")) if q is None else percentiles(sizes, "size", {"high": q / 100})
    return high.select((-F.col("high")).alias("low"), "high")


def movie_status(curve: DataFrame) -> DataFrame:
    """The line shown with each window: number, count, center, accuracies."""
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return curve.select("window", F.format_string("window %d/%d | center %d | frame %.3f | trial %.3f", (F.col("window") + 1).cast("int"), n.cast("int"), F.col("center").cast("int"), "frame_acc", "trial_acc").alias("status"))
