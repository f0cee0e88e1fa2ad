"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a part of all words, and the most that any source is repeated.
SHARE, MOST = 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: the level at which all sources take share * all words.

    Each source takes level * weight, but at most most * source_size. Sorted by the level at which a
    source is full, the level is found with prefix sums: the first source that is not full has the largest of the possible levels. Works on
    one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    src = src.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)).alias("open_w"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open_w")
    src = src.withColumn("level", F.max(F.when(level <= F.col("cap") / F.col("w"), level)).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return src.select("source", "source_size", target.alias("target"))


def _offset(seed: int):
    """The random offset of a source in [0, 1): 28 bits of an md5, so that reruns and other engines agree."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def mix(documents: DataFrame, carry: list[str] = (), seed: int = 42, **targets) -> DataFrame:
    """Copies of every document that the mix takes: carry, size, source, source_size, target, copies.

    Within a source every document is expected target / source_size times. In the order of
    (size, doc_id) the expectations are summed and a random offset added; a document is emitted once
    for each integer passed, so a source of any size is sampled evenly over short and long documents
    and its words differ from the target by about one long document. Null text counts 0 words, a null
    source is a source of its own (the last), repeated rows count one by one, and an empty table
    gives no rows. Ranks within a source come from a range sort and per-partition counts, so a hot
    source spreads over all tasks.
    """
    sizes = documents.select(*dict.fromkeys(["doc_id", "source", *carry]), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = shared.materialize(sizes, "mix-sizes")
    rows = shared.ordered_rows(sizes, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()], "mix-rows")
    runs = rows.groupBy("_pid", "source").agg(F.count(F.lit(1)).alias("n"), F.min("_idx").alias("first"))
    before = W.partitionBy("source").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    goals = source_targets(sizes, **targets).withColumnRenamed("source", "s")
    runs = runs.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("_pid").alias("p"), "s", "base", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    placed = rows.join(runs, (F.col("_pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("u", _offset(seed))
    rank = F.col("base") + F.col("_idx")
    copies = F.floor(F.col("rate") * (rank + 1) + F.col("u")) - F.floor(F.col("rate") * rank + F.col("u"))
    return placed.withColumn("copies", copies.cast("long")).drop("_pid", "_idx", "p", "s", "base", "rate", "u")


def apply_mix(documents: DataFrame, seed: int = 42, **targets) -> DataFrame:
    """The mixed documents themselves: every row as often as the mix takes it, with its columns.

    Handles nulls, repeated rows and empty tables as mix does; columns may have any names.
    """
    columns, rid, copy = documents.columns, shared.fresh_name(documents, "_rid"), shared.fresh_name(documents, "_copy")
    tagged = shared.materialize(documents.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    sized = tagged.select("doc_id", "source", "text", F.col(rid).alias("_row"))
    taken = mix(sized, ["_row"], seed, **targets).where(F.col("copies") > 0).select(F.col("_row").alias(rid), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(copy))
    return tagged.join(taken, rid).withColumn(copy, F.explode(copy)).select(*columns)
