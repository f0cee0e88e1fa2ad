"""Running sums and ranks over a whole table without one task that sees all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a range that one task sorts, and ranges at most.
ROWS, RANGES = 100_000, 1000


def ranges(table: DataFrame, order: str) -> Column:
    """The number of the range of the numeric column `order` in which a row lies, from 0; rising with it.

    Range borders are approximate percentiles, a bounded number of constants; rows with one value share
    a range.
    """
    n = table.count()
    parts = min(RANGES, -(-n // ROWS))
    if parts < 2:
        return F.lit(0)
    cuts = table.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * RANGES)).first()[0]
    borders = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return F.size(F.filter(borders, lambda b: b <= F.col(order)))


def running_sums(table: DataFrame, order: str, sums: dict[str, Column], keys: tuple = (), place: Column | None = None) -> DataFrame:
    """table with the sums of the given columns over the rows before, in the order of the column `order`.

    Within the keys no two rows may have one value of `order`. Each range is summed by itself; the sums
    of the ranges before it are a window over one row per key and range, joined back. `place` gives the
    range where it is known how the values spread.
    """
    table = table.withColumn("_range", ranges(table, order) if place is None else place)
    inside = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = table.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    bases = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_base_range"), *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums])
    here = table.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_here_{k}") for k, c in sums.items()])
    on = F.col("_range") == F.col("_base_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    columns = [c for c in table.columns if c != "_range"]
    return here.join(bases, on).select(*columns, *[(F.col(f"_here_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])


def ranked(table: DataFrame, order: str, out: str, keys: tuple = ()) -> DataFrame:
    """table with `out`: the number of rows before a row, within the keys."""
    return running_sums(table, order, {out: F.lit(1)}, keys)


def minima_from_end(table: DataFrame, order: str, value: str, out: str, keys: tuple = (), place: Column | None = None) -> DataFrame:
    """table with `out`: the least `value` of a row and those after it, in the order of the column `order`.

    Each range by itself, and the least values of the ranges after it from a window over one row per key and range.
    """
    table = table.withColumn("_range", ranges(table, order) if place is None else place)
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    totals = table.groupBy(*keys, "_range").agg(F.min(value).alias("_least"))
    bases = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_base_range"), F.min("_least").over(after).alias("_after"))
    on = F.col("_range") == F.col("_base_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    columns = [c for c in table.columns if c not in ("_range", out)]
    return table.withColumn("_here", F.min(value).over(inside)).join(bases, on).select(*columns, F.least("_here", "_after").alias(out))


def percentiles(table: DataFrame, value: str, at: dict[str, Column | float], keys: tuple = ()) -> DataFrame:
    """keys and a column for each entry of `at`: the exact percentile of the numeric column `value`, interpolated.

    `at` gives shares from 0 to 1, which may depend on the keys. Equal values are counted first, so a frequent
    value is one row, and ranks are running sums of these counts, so no task holds all values of a key. Null
    values are left out; NaN counts as the largest. A key without values has no row, except for the only row without keys.
    """
    counts = table.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counts, value, {"_before": F.col("_n")}, keys)
    named = [F.col(k).alias(f"_of_{k}") for k in keys]
    places = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    places = places.select(*named, *[((F.col("_all") - 1) * share).alias(f"_at_{name}") for name, share in at.items()])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    rows = placed.join(places if keys else F.broadcast(places), on)  # without keys: one row
    holds = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
    sides = [F.max(F.when(holds(side(F.col(f"_at_{name}"))), F.col(value))).alias(f"_{end}_{name}") for name in at for end, side in (("low", F.floor), ("high", F.ceil))]
    out = rows.groupBy(*keys).agg(*sides, *[F.max(f"_at_{name}").alias(f"_at_{name}") for name in at])

    def between(name: str) -> Column:
        low, high, place = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_at_{name}")
        mixed = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(mixed).alias(name)

    return out.select(*keys, *[between(name) for name in at])
