"""Selection and reshaping of cubes: regions, windows, samples, bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import skip_nan
from .ranking import ranked


def in_region(cube: DataFrame, roi: DataFrame) -> DataFrame:
    """Cells whose pixel is in roi(pixel). A region is a part of one image; Spark broadcasts it if small."""
    return cube.join(roi, "pixel", "left_semi")


def outside_region(cube: DataFrame, roi: DataFrame) -> DataFrame:
    return cube.join(roi, "pixel", "left_anti")


def region_from_polygon(points: list[tuple[float, float]], side: int, pixels: DataFrame) -> DataFrame:
    """Pixels (pixel = x + side * y) whose centres lie inside a polygon: even-odd crossings of its edges."""
    if len(points) < 3:
        raise ValueError("a polygon needs three points")
    x, y = F.col("pixel") % side + 0.5, F.floor(F.col("pixel") / F.lit(side)) + 0.5
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            inside = inside != crosses
    return pixels.where(inside).select("pixel")


def extract_window(cube: DataFrame, start: int, end: int, n_frames: int | None = None) -> DataFrame:
    """Frames [start, end); an error if they go past the cube (its frame count is asked for if not given)."""
    n_frames = (cube.agg(F.max("frame")).first()[0] or -1) + 1 if n_frames is None else n_frames
    if start < 0 or end > n_frames or start >= end:
        raise ValueError(f"window [{start}, {end}) is not inside 0..{n_frames}")
    return cube.where((F.col("frame") >= start) & (F.col("frame") < end))


def window_average(cube: DataFrame, start: int, end: int) -> DataFrame:
    """Mean of the window's frames per trial and pixel, NaN left out."""
    return extract_window(cube, start, end).groupBy("trial", "pixel").agg(F.avg(skip_nan(F.col("value"))).alias("value"))


def balanced(trials: DataFrame, label: str = "y", keys: tuple = ()) -> DataFrame:
    """The first n trials of each label, n being the smaller count, numbered anew: label 1 first.

    trials(trial, y) has one row per trial; keys part data sets that are balanced each by itself.
    """
    n = trials.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.min("k").alias("n"))
    rows = ranked(trials, "trial", "rank", (*keys, label))
    rows = rows.join(n, list(keys)) if keys else rows.crossJoin(F.broadcast(n))  # one row
    place = F.col("rank") + F.when(F.col(label) == 1, F.lit(0)).otherwise(F.col("n"))
    return rows.where("rank < n").select(*keys, "trial", label, place.cast("int").alias("index"))


def pairwise_dataset(cube: DataFrame, face: int, nonface: int, keys: tuple = ()) -> DataFrame:
    """Cells of two conditions with equal trial counts: trial numbered anew (face first), y 1 for face."""
    two = cube.where(F.col("cond").isin(face, nonface)).withColumn("y", F.when(F.col("cond") == face, 1).otherwise(0))
    return balanced_cells(two, keys)


def balanced_cells(cube: DataFrame, keys: tuple = ()) -> DataFrame:
    """Cells (with y) of the trials that balanced keeps, numbered anew."""
    index = balanced(cube.select(*keys, "trial", "y").distinct(), "y", keys)
    return cube.join(index, [*keys, "trial", "y"]).drop("trial").withColumnRenamed("index", "trial")


def frames_as_samples(cube: DataFrame, start: int, n_frames: int) -> DataFrame:
    """One sample per (trial, frame): sample_id, trial (the group), frame, y, features in pixel order."""
    cells = F.array_sort(F.collect_list(F.struct("pixel", "value")))
    rows = cube.groupBy("trial", "frame", "y").agg(F.transform(cells, lambda c: c["value"]).alias("features"))
    return rows.withColumn("sample_id", F.col("trial") * n_frames + F.col("frame") - start)


def relative_change(cube: DataFrame) -> DataFrame:
    return cube.withColumn("value", F.col("value") - 1)


def keep_or_null(cube: DataFrame, mask: DataFrame) -> DataFrame:
    """value where the pixel is in mask(pixel), else null."""
    marked = mask.select("pixel", F.lit(True).alias("_in"))
    return cube.join(marked, "pixel", "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")


def image_side(n_pixels: int) -> int:
    side = round(math.sqrt(n_pixels))
    if side * side != n_pixels:
        raise ValueError(f"{n_pixels} pixels are no square image")
    return side


def superpixels(cube: DataFrame, n: int, xs: int, ys: int, keys: tuple = ("frame",)) -> DataFrame:
    """Means over blocks of xs // n by ys // n pixels; the rest at the edges is left out."""
    xb, yb = xs // n, ys // n
    col = F.floor((F.col("pixel") % xs) / F.lit(xb)).cast("int")
    row = F.floor(F.floor(F.col("pixel") / F.lit(xs)) / F.lit(yb)).cast("int")
    placed = cube.withColumn("col", col).withColumn("row", row).where((F.col("col") < xs // xb) & (F.col("row") < ys // yb))
    out = placed.groupBy("row", "col", *keys).agg(F.avg("value").alias("mean"))
    return out.withColumn("plot", (F.col("row") * (xs // xb) + F.col("col")).cast("int"))


def time_bins(cube: DataFrame, n: int, first: int, n_frames: int, keys: tuple = ("pixel",)) -> DataFrame:
    """Means of n consecutive frames, labelled with the first; a rest of less than n frames is left out."""
    if n < 1 or n > n_frames:
        raise ValueError("bins must hold 1 to n_frames frames")
    at = F.col("frame") - first
    rows = cube.where((at >= 0) & (at < n_frames // n * n)).withColumn("bin", F.floor(at / F.lit(n)).cast("int"))
    return rows.groupBy("bin", *keys).agg(F.avg("value").alias("mean"), F.min("frame").alias("first_frame"))


def window_starts(n_frames: int, size: int, start: int, stop: int, step: int = 1) -> tuple[int, int]:
    """First and last start of the sliding windows."""
    last = min(n_frames - size, min(stop, n_frames) - size)
    if last < start:
        raise ValueError("no window fits")
    return start, start + (last - start) // step * step


def sliding_windows(cube: DataFrame, size: int, first: int, last: int, step: int = 1) -> DataFrame:
    """Each cell once for every window that covers its frame, with window (number) and center.

    The windows of a frame are a sequence computed from the frame, so there is no range join.
    """
    rows = cube.where((F.col("frame") >= first) & (F.col("frame") < last + size))
    low = F.greatest(F.col("frame") - size + 1, F.lit(first))
    low = F.lit(first) + F.ceil((low - first) / F.lit(step)) * step
    high = F.least(F.col("frame"), F.lit(last))
    rows = rows.withColumn("_lo", low.cast("int")).withColumn("_hi", high.cast("int")).where("_lo <= _hi")
    rows = rows.withColumn("_start", F.explode(F.sequence("_lo", "_hi", F.lit(step))))
    return rows.withColumn("window", ((F.col("_start") - first) / F.lit(step)).cast("int")).withColumn("center", (F.col("_start") + size // 2).cast("int")).drop("_lo", "_hi", "_start")


def window_means(cube: DataFrame, value: str, size: int, first: int, last: int, step: int = 1, keys: tuple = (), leave_out_nan: bool = False) -> DataFrame:
    """Mean of a column over the cells of each sliding window: (window, center, keys, mean).

    Cells are summed per frame first, before any shuffle; only these sums, a row per frame and key, are
    copied to the windows that cover their frame. So a cell is read once, whatever the size. A sum over few
    frames loses no digits, as differences of running sums would. A NaN makes the windows over its frame
    NaN, and no others, or is left out. A window without values has no row, or null if all are null.
    """
    x = skip_nan(F.col(value)) if leave_out_nan else F.col(value)
    frames = cube.groupBy(*keys, "frame").agg(F.sum(x.cast("double")).alias("_sum"), F.count(x).alias("_n"))
    rows = sliding_windows(frames, size, first, last, step).groupBy("window", "center", *keys)
    return rows.agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean"))


def finite_only(table: DataFrame, column: str) -> DataFrame:
    from ..functions.numeric import is_finite

    return table.where(is_finite(F.col(column)))


def coordinates(pixel: Column, side: int) -> tuple[Column, Column]:
    """x and y of a pixel number."""
    return pixel % side, F.floor(pixel / F.lit(side)).cast("int")
