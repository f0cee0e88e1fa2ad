"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder, small_batches, vocabulary_size

LENGTH = 2048
#: Hash buckets of a document's vector, dimensions of the projection, and bits of each for the curve.
BUCKETS, DIMS, BITS = 512, 3, 10
_SEED = 20240517


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (n, dims) on the Hilbert curve with `bits` bits an axis.

    The axes are turned into the transposed form of the key by undoing the curve's rotations and
    reflections from the highest bit down, then Gray-decoding; the bits are interleaved at the end.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            up = (x[d] & high) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def curve_keys(ids: list[np.ndarray], buckets: int = BUCKETS, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents: token ids hashed to a count vector, scaled to length 1, projected."""
    axes = np.random.default_rng(_SEED).standard_normal((buckets, dims))
    counts = np.zeros((len(ids), buckets))
    for row, x in zip(counts, ids, strict=True):
        row += np.bincount((x * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    top = (1 << bits) - 1
    return hilbert_key(np.clip((counts @ axes / 4 + 0.5) * top, 0, top).astype(np.int64), bits)


def encoded(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """_rid, doc_id, n_tokens, curve_key and ids (16 bits each if they fit) of every document, materialized."""
    tail, vocabulary = np.array([end_id], "<u4").tobytes(), vocabulary_size(tokenizer, end_id)

    def rows(batches):
        enc = encoder(tokenizer)
        small = vocabulary <= 1 << 16
        for batch in shared.in_slices(batches):
            names, texts = batch["doc_id"], batch["text"].to_pylist()
            for i, j in small_batches(texts):
                ids = [np.frombuffer(x + tail, "<u4") for x in enc.encode(texts[i:j])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": names.slice(i, j - i),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "curve_key": pa.array(curve_keys(ids), pa.int64()),
                        "ids": pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in ids], pa.binary()),
                    }
                )

    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInArrow(rows, "doc_id long, n_tokens long, curve_key long, ids binary")
    return shared.materialize(out.withColumn("_rid", F.monotonically_increasing_id()), "pack-ids")


def _cumulate(batches):
    """Adds the partition and the tokens before each row in it; partitions are sorted along the curve."""
    pid, held = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch["n_tokens"].to_numpy()
        before = held + np.cumsum(n) - n
        held += int(n.sum())
        yield pa.RecordBatch.from_pydict({"_rid": batch["_rid"], "n_tokens": batch["n_tokens"], "_pid": pa.array(np.full(len(n), pid, np.int32)), "rel": pa.array(before)})


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Documents are laid end to end in the order of their Hilbert keys and cut every `length` tokens,
    so neighbours on the curve share sequences and only the very last one is padded. Only keys and
    counts are sorted; ties on the curve (copies) are parted by doc_id, so a frequent key spreads
    over ranges. A null text counts as empty: its end id alone. Null and repeated doc_ids are kept.
    An empty table gives no pieces.
    """
    docs = encoded(documents, tokenizer, end_id)
    order = [F.col("curve_key"), F.col("doc_id"), F.col("_rid")]
    placed = docs.select("_rid", "n_tokens", "curve_key", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("_rid", "n_tokens").mapInArrow(_cumulate, "_rid long, n_tokens long, _pid int, rel long")
    placed = shared.materialize(placed, "pack-order")
    base = shared.running_base(placed.groupBy("_pid").agg(F.sum("n_tokens").alias("n")), "n", "base").select("_pid", "base")
    placed = placed.join(F.broadcast(base), "_pid").select("_rid", (F.col("base") + F.col("rel")).alias("at"))

    def cut(batches):
        for batch in batches:
            cols: dict = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc, n, raw, at in zip(*(batch[k].to_pylist() for k in ("doc_id", "n_tokens", "ids", "at")), strict=True):
                ids, start = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    for k, v in zip(cols, (doc, start, size, ids[start : start + size].tobytes(), n, sequence, offset), strict=True):
                        cols[k].append(v)
                    start += size
            kinds = {"ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()})

    joined = docs.join(placed, "_rid").select("doc_id", "n_tokens", "ids", "at")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_crc32(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 instead of the ids (little-endian unsigned 32-bit)."""
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
