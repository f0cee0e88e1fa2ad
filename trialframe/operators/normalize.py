"""Normalisation of cubes: statistics of the baseline or blank cells, joined back onto all cells.

A cube is a long table with the columns session, cond, trial, frame, pixel and value, or those of
them that a keys parameter names. Only the cells that a statistic needs are aggregated; the small
result is joined, so Spark broadcasts it where its size allows and the cells then stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import away_from_zero, skip_nan


def _frames(frames: list[int] | None, frame_range: tuple[int, int] | None) -> Column:
    """A frame list, or a half-open range."""
    if (frames is None) == (frame_range is None):
        raise ValueError("give either frames or frame_range")
    if frames is not None:
        return F.col("frame").isin(frames)
    return (F.col("frame") >= frame_range[0]) & (F.col("frame") < frame_range[1])


def joined_by(cube: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """cube with the columns of stats, whose keys get names of their own; no match gives nulls."""
    named = stats.select(*[F.col(k).alias(f"_by_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]
    return cube.join(named, on, "left").drop(*[f"_by_{k}" for k in keys])


def frame_zero(cube: DataFrame, frames: list[int] | None = None, frame_range: tuple[int, int] | None = None, eps: float = 1e-12, keys: tuple = ("session", "cond", "pixel", "trial")) -> DataFrame:
    """value / mean of the zero frames of its keys, kept eps away from zero."""
    base = cube.where(_frames(frames, frame_range)).groupBy(*keys).agg(F.avg("value").alias("_base"))
    out = joined_by(cube, base, list(keys))
    return out.withColumn("value", F.try_divide("value", away_from_zero(F.col("_base"), eps))).select(*cube.columns)


def blank(cube: DataFrame, blank_cond: int, eps: float = 1e-12, strict: bool = False) -> DataFrame:
    """Every condition divided by the mean blank trial of its session, pixel and frame; the blank unchanged.

    A cell without a blank partner is null; strict: a session without any blank is an error. Blank
    means are one row per session, pixel and frame.
    """
    if strict and (bad := sessions_without_blank(cube, blank_cond).limit(10).collect()):
        raise ValueError(f"sessions without blank: {sorted(r.session for r in bad)}")
    mean = cube.where(F.col("cond") == blank_cond).groupBy("session", "pixel", "frame").agg(F.avg(skip_nan(F.col("value"))).alias("_mean"))
    safe = F.when(F.abs("_mean") < eps, F.lit(eps)).otherwise(F.col("_mean"))
    out = joined_by(cube, mean, ["session", "pixel", "frame"])
    return out.withColumn("value", F.when(F.col("cond") == blank_cond, F.col("value")).otherwise(F.try_divide("value", safe))).select(*cube.columns)


def sessions_without_blank(cube: DataFrame, blank_cond: int) -> DataFrame:
    """Sessions that blank() cannot normalise."""
    return cube.groupBy("session").agg(F.max((F.col("cond") == blank_cond).cast("int")).alias("has")).where("has = 0").select("session")


def zscore_pooled(cube: DataFrame, baseline: tuple[int, int], ddof: int = 0, eps: float = 1e-8, keys: tuple = ()) -> DataFrame:
    """z, mu and sd: value less its trial's baseline mean, over the pixel's pooled baseline deviation.

    keys part data sets (sessions, conditions) that must not be pooled. Baseline values centred by
    their trial's mean have mean zero, so the pooled variance is the sum of the trials' squared
    deviations over the number of values less ddof.
    """
    inside = cube.where(_frames(None, baseline))
    trials = inside.groupBy(*keys, "pixel", "trial").agg(F.avg("value").alias("mu"), (F.var_pop("value") * F.count("value")).alias("_m2"), F.count("value").alias("_n"))
    pixels = trials.groupBy(*keys, "pixel").agg(F.sqrt(F.try_divide(F.sum("_m2"), (F.sum("_n") - ddof).cast("double"))).alias("sd"))
    stats = joined_by(trials.drop("_m2", "_n"), pixels, [*keys, "pixel"])
    out = joined_by(cube, stats, [*keys, "pixel", "trial"])
    return out.withColumn("z", (F.col("value") - F.col("mu")) / F.greatest(F.col("sd"), F.lit(eps)))


def zscore_per_trial(cube: DataFrame, baseline: tuple[int, int], eps: float = 1e-6, keys: tuple = ()) -> DataFrame:
    """z with mean and deviation of each trial's baseline at a pixel, NaN left out."""
    x = skip_nan(F.col("value"))
    stats = cube.where(_frames(None, baseline)).groupBy(*keys, "pixel", "trial").agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"))
    out = joined_by(cube, stats, [*keys, "pixel", "trial"])
    return out.withColumn("z", (F.col("value") - F.col("_mu")) / F.greatest(F.col("_sd"), F.lit(eps))).drop("_mu", "_sd")


def baseline_check(cube: DataFrame, baseline: tuple[int, int], column: str = "z") -> DataFrame:
    """Mean and deviation of the whole baseline; about 0 and 1 after zscore_pooled."""
    return cube.where(_frames(None, baseline)).agg(F.avg(skip_nan(F.col(column))).alias("mean"), F.stddev_pop(skip_nan(F.col(column))).alias("std"))


def _with_extremes(table: DataFrame, partition: list[str], **extremes: Column) -> DataFrame:
    """table with aggregates of its partition, joined back; without partition one row for all."""
    stats = table.groupBy(*partition).agg(*[c.alias(k) for k, c in extremes.items()])
    return joined_by(table, stats, list(partition)) if partition else table.crossJoin(F.broadcast(stats))


def max_abs_scaled(table: DataFrame, column: str, out: str, partition: list[str] = ()) -> DataFrame:
    """column / largest |column| of the partition."""
    both = _with_extremes(table, list(partition), _most=F.max(F.abs(skip_nan(F.col(column)))))
    return both.withColumn(out, F.try_divide(column, "_most")).drop("_most")


def min_max_scaled(table: DataFrame, column: str, out: str, partition: list[str] = ()) -> DataFrame:
    """column scaled to [0, 1]; a constant or missing value gives 0."""
    x = skip_nan(F.col(column))
    both = _with_extremes(table, list(partition), _low=F.min(x), _high=F.max(x))
    return both.withColumn(out, F.coalesce(F.try_divide(x - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))).drop("_low", "_high")


def factorised(table: DataFrame, column: str, out: str) -> DataFrame:
    """Codes 0, 1, ... of the distinct values in order; the distinct values are few and joined back."""
    codes = table.select(column).distinct().withColumn(out, F.dense_rank().over(W.orderBy(column)) - 1)
    return table.join(codes, column)


def row_normalised(counts: DataFrame) -> DataFrame:
    """Confusion counts n as shares of their true label, an empty label giving 0."""
    total = F.sum("n").over(W.partitionBy("y_true"))
    return counts.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))
