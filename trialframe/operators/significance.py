"""Permutation nulls, p-values, false-discovery control and rank sums."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.numeric import is_finite, normal_tail
from .ranking import ROWS, minima_from_end, ranked, ranges, running_sums
from .validation import require

CHANCE = 0.5


def permuted_labels(trials: DataFrame, n_permutations: int) -> DataFrame:
    """(perm, trial, y_perm): the labels of trials(trial, y) in md5 order of perm and trial.

    Reproducible in any engine; label counts are kept in every permutation. Ranks in md5 order are
    counted in ranges of the first digits of the md5, which spread evenly.
    """
    parts = max(1, -(-trials.count() // ROWS))
    labels = ranked(trials, "trial", "rk").select("y", "rk")
    keyed = trials.select("trial", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("perm"))
    keyed = keyed.withColumn("_key", F.md5(F.concat(F.col("perm").cast("string"), F.lit(":"), F.col("trial").cast("string"))))
    place = F.floor(F.conv(F.substring("_key", 1, 6), 16, 10).cast("long") * parts / F.lit(float(1 << 24))).cast("int")
    keyed = running_sums(keyed, "_key", {"rk": F.lit(1)}, ("perm",), place).select("perm", "trial", "rk")
    return keyed.join(labels, "rk").select("perm", "trial", F.col("y").alias("y_perm"))


def p_value(null: Column, real: Column, tails: str = "one") -> Column:
    """(hits + 1) / (n + 1): nulls at or beyond the real value, or, two-tailed, at least as far from chance.

    Values are compared after rounding to 12 places, so that equal ratios count as equal.
    """
    far = (lambda x: x) if tails == "one" else (lambda x: F.abs(x - CHANCE))
    hit = F.round(far(null), 12) >= F.round(far(real), 12)
    return (F.sum(hit.cast("int")) + 1) / (F.count(null) + 1)


def fixed_significance(null: DataFrame, real: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row from null(score) and the one-row real(score): both p-values, null moments, pass marks."""
    joined = null.select(F.col("score").alias("null")).crossJoin(F.broadcast(real.select(F.col("score").alias("real"))))
    out = joined.agg(
        F.max("real").alias("real"), p_value(F.col("null"), F.col("real")).alias("p_one_tailed"), p_value(F.col("null"), F.col("real"), "two").alias("p_two_tailed"),
        F.avg("null").alias("null_mean"), F.stddev_samp("null").alias("null_std"), F.min("null").alias("null_min"), F.max("null").alias("null_max"), F.count("null").alias("n"),
    )
    return out.withColumn("pass_one_tailed", F.col("p_one_tailed") < alpha).withColumn("pass_two_tailed", F.col("p_two_tailed") < alpha)


def p_text(p: Column, n: Column) -> Column:
    """How a p-value is shown: `p < 1/(n+1)` at the smallest that n permutations can give."""
    least = 1 / (n + 1)
    return F.when(p <= least, F.format_string("p < %.4f", least.cast("double"))).otherwise(F.format_string("p = %.4f", p.cast("double")))


def benjamini_hochberg(table: DataFrame, p: str = "p", out: str = "p_fdr", keys: tuple = ()) -> DataFrame:
    """Adjusted p-values: p * m / rank, made monotone from the largest down, at most 1; null where p is null.

    Equal p-values, which have the rank of the last of them, are counted first; ranks and minima then go
    range by range, so the tests of one key may be any number.
    """
    values = table.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_at", ranges(values, "_p"))
    summed = running_sums(values, "_p", {"_before": F.col("_n")}, keys, F.col("_at"))
    m = values.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    summed = _with(summed, m, keys).withColumn("_q", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_n")))
    least = minima_from_end(summed, "_p", "_q", out, keys, F.col("_at")).select(*keys, "_p", F.least(F.lit(1.0), F.col(out)).alias(out))
    return _with(table.withColumn("_p", F.col(p)), least, (*keys, "_p")).drop("_p")


def _with(table: DataFrame, more: DataFrame, keys: tuple) -> DataFrame:
    """table with the columns of `more` at equal keys, nulls being equal too; null where there are none."""
    named = more.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in more.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    joined = table.join(named, on, "left") if keys else table.crossJoin(F.broadcast(named))
    return joined.drop(*[f"_same_{k}" for k in keys])


def window_significance(null: DataFrame, real: DataFrame, tails: str = "two", alpha: float = 0.001, strict: bool = False) -> DataFrame:
    """Per window: p of the real mean among null means, adjusted over all windows, and whether below alpha.

    null(perm, window, score) and real(window, score) hold means over folds. Windows that only one side has are
    left out. strict: such a window, a second real value or windows with different numbers of permutations fail
    the query, and n_nan counts the null scores that are NaN, which no comparison counts as smaller.
    """
    joined = null.select("window", F.col("score").alias("null")).join(real.select("window", F.col("score").alias("real"), F.lit(1).alias("_real")), "window", "full" if strict else "inner")
    more = [F.count("null").alias("_n"), F.count("_real").alias("_rows"), F.count_distinct("real").alias("_reals"), F.count_if(F.isnan("null")).alias("n_nan")] if strict else []
    p = joined.groupBy("window").agg(F.max("real").alias("real"), p_value(F.col("null"), F.col("real"), tails).alias("p"), *more)
    if strict:
        most = F.max("_n").over(W.partitionBy(F.lit(0)))  # a row per window
        right = (F.col("_n") > 0) & (F.col("_rows") == F.col("_n")) & (F.col("_reals") == 1) & (F.col("_n") == F.col("_most"))
        p = p.withColumn("_most", most).withColumn("p", require(F.col("p"), right, "windows or permutations of real and null scores do not match")).drop("_n", "_rows", "_reals", "_most")
    out = benjamini_hochberg(p)
    return out.withColumn("significant", F.col("p_fdr") < alpha)


def null_band(null: DataFrame, k: float = 3.0) -> DataFrame:
    """Per window: null mean and mean +- k sample deviations."""
    out = null.groupBy("window").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    return out.select("window", "mean", (F.col("mean") - k * F.col("std")).alias("low"), (F.col("mean") + k * F.col("std")).alias("high"))


#: Size of the smaller sample up to which rank sums without ties are exact.
EXACT = 8


@cache
def rank_sum_tails(small: int, large: int) -> np.ndarray:
    """P(U >= u) for u from 0 on, of two samples without ties, all orders being equally likely.

    The number of orders with U = u is a coefficient of the Gaussian binomial in q, the product of
    (1 - q^(large + i)) / (1 - q^i) for i up to small, kept in whole numbers.
    """
    degree = small * large
    counts = [1] + [0] * degree
    for i in range(1, small + 1):
        for u in range(degree, large + i - 1, -1):
            counts[u] -= counts[u - large - i]
        for u in range(i, degree + 1):
            counts[u] += counts[u - i]
    total, above, out = sum(counts), 0, np.zeros(degree + 1)
    for u in range(degree, -1, -1):
        above += counts[u]
        out[u] = above / total
    return out


def _exact(alternative: str):
    """Fills p of the rows with few values on a side and no ties."""

    def run(frames):
        for pdf in frames:
            small = ((pdf["ties"] == 0) & (np.minimum(pdf["n1"], pdf["n2"]) <= EXACT)).to_numpy()
            for i in np.flatnonzero(small):
                n1, n2, u = int(pdf["n1"].iat[i]), int(pdf["n2"].iat[i]), int(pdf["u"].iat[i])
                tails = rank_sum_tails(min(n1, n2), max(n1, n2))
                above, below = tails[u], tails[n1 * n2 - u]
                pdf.loc[pdf.index[i], "p"] = {"greater": above, "less": below, "two_sided": min(1.0, 2 * min(above, below))}[alternative]
            yield pdf[["window", "u", "z", "p"]]

    return run


def rank_sum(real: DataFrame, null: DataFrame, alternative: str = "greater") -> DataFrame:
    """Mann-Whitney per window of real(window, score) against null(window, score).

    Mean ranks of ties, tie-corrected normal approximation with continuity correction; exact where no value
    repeats and a side has at most EXACT; a side without values gives p = 1. Equal values are counted before they are
    ranked, and ranks go range by range, so a window may have any number of values.
    """
    if alternative not in ("greater", "less", "two_sided"):
        raise ValueError("alternative is greater, less or two_sided")
    both = real.select("window", "score", F.lit(1).alias("own")).unionByName(null.select("window", "score", F.lit(0).alias("own"))).where(is_finite(F.col("score")))
    values = both.groupBy("window", "score").agg(F.sum("own").alias("a"), F.count(F.lit(1)).alias("t"))
    values = running_sums(values, "score", {"below": F.col("t")}, ("window",))
    values = values.withColumn("r", F.col("a") * (F.col("below") + (F.col("t") + 1) / 2.0))
    t = F.col("t").cast("double")
    s = values.groupBy("window").agg(F.sum("r").alias("r"), F.sum("a").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"))
    s = s.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    var = F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1)))
    s = s.withColumn("d", F.col("u") - F.col("n1") * F.col("n2") / 2).withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    half = {"greater": F.col("d") - 0.5, "less": -F.col("d") - 0.5, "two_sided": F.abs("d") - 0.5}[alternative]
    s = s.withColumn("z", F.try_divide(half, F.col("sd")))
    tail = normal_tail(F.col("z")) * (2 if alternative == "two_sided" else 1)
    s = s.withColumn("p", F.least(F.lit(1.0), F.coalesce(tail, F.lit(1.0)))).select("window", "n1", "n2", "ties", "u", "z", "p")
    return s.mapInPandas(_exact(alternative), T.StructType([s.schema[c] for c in ("window", "u", "z", "p")]))


def rank_sum_adjusted(real: DataFrame, null: DataFrame, alternative: str = "greater", alpha: float = 0.05) -> DataFrame:
    """rank_sum with p-values adjusted over all windows, and whether they lie below alpha."""
    out = benjamini_hochberg(rank_sum(real, null, alternative))
    return out.withColumn("significant", F.col("p_fdr") < alpha)


def first_windows(table: DataFrame, n: int = 45) -> DataFrame:
    """The first n windows of a result; p-values stay as they were adjusted over all windows."""
    return table.where(F.col("window") < n)
