"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Half rounds of the network; each adds a keyed hash of one half to the other half.
HALF_ROUNDS = 8
#: Steps of the cycle walk. The domain exceeds the rows by less than its square root, so already
#: the second step is rare; a row outside after all steps (chance below n ** -30) raises an error.
WALK_STEPS = 64


def _domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(row_no: str, n: int, seed: int) -> Column:
    """The place in 0..n-1 that the keyed permutation gives to the row number in column row_no.

    Numbers are split into halves x div b and x mod b of a mixed-radix domain a * b >= n; results
    outside 0..n-1 are permuted again until they fall inside, which keeps the map one-to-one.
    """
    a, b = _domain(n)
    keys = ",".join(f"{seed * 1000003 + k}L" for k in range(HALF_ROUNDS))

    def network(x: str, v: str) -> str:
        left = f"((({v} div {b}L) + pmod(xxhash64({v} % {b}L, k_{v}), {a}L)) % {a}L) * {b}L + {v} % {b}L"
        right = f"({v} div {b}L) * {b}L + ({v} % {b}L + pmod(xxhash64({v} div {b}L, k_{v}), {b}L)) % {b}L"
        return f"aggregate(array({keys}), {x}, ({v}, k_{v}) -> if(k_{v} % 2 = 0, {left}, {right}))"

    walk = f"aggregate(sequence(1, {WALK_STEPS}), {network(row_no, 'x')}, (y, i) -> if(y < {n}L, y, {network('y', 'z')}))"
    return F.expr(f"transform(array({walk}), p -> if(p < {n}L, p, cast(raise_error('cycle walk did not end') as bigint)))[0]")


def assign_shards(rows: DataFrame, order: list[Column], n_shards: int, seed: int = 42) -> DataFrame:
    """rows with `shard` (0..n_shards-1) and `slot` (gapless from 0 in each shard).

    Rows are numbered in the given global order; the permuted number p gives shard p mod n_shards
    and slot p div n_shards, so shard sizes differ by one at most, whatever keys or copies are
    frequent, and the place of row number r can be computed without reading the table. Rows equal
    in all ordering columns are interchangeable. Nulls sort first; an empty table gives no rows.
    """
    numbered = shared.with_row_numbers(rows, order, "shard-rows", "_row_no")
    n = numbered.count()
    return (
        numbered.withColumn("_place", permuted("_row_no", n, seed))
        .withColumn("shard", (F.col("_place") % n_shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / F.lit(n_shards)).cast("long") if n < 1 << 52 else F.expr(f"_place div {n_shards}"))
        .drop("_pid", "_idx", "_row_no", "_place")
    )


def document_shards(documents: DataFrame, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """Shard and slot of every document: doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot.

    A null text counts as empty (size 8, crc 0). Null and repeated doc_ids are kept as rows of
    their own. Only these narrow columns are sorted and written, never the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    )
    return assign_shards(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards, seed)


def write_shards(documents: DataFrame, shards: DataFrame, path: str) -> None:
    """Write documents as Parquet folders shard=K, each sorted by slot. doc_id must be a key here."""
    joined = documents.join(shards.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
