"""Vectors of an embedding column as compact bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def as_bytes(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, _vec, _dim): components as little-endian doubles or floats, as the column has them.

    _vec is null and _dim 0 if the vector is null, empty, zero or holds a null or non-finite component.
    """
    kind = embeddings.schema[column].dataType.elementType.simpleString()
    width = "<f4" if kind == "float" else "<f8"

    def rows(batches):
        for batch in batches:
            lists = batch["_v"]
            flat, edges = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            parts = [flat[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
            good = [v.is_valid and bool(np.isfinite(x).all() and x.any()) for v, x in zip(lists, parts, strict=True)]
            data = [x.astype(width).tobytes() if g else None for x, g in zip(parts, good, strict=True)]
            dims = [len(x) if g else 0 for x, g in zip(parts, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(data, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "_vec", "_dim"])

    source = embeddings.select(F.col("vec_id").cast("long"), F.col(column).cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("_v"))
    return source.mapInArrow(rows, "vec_id long, _vec binary, _dim int")


def matrix(data, dim: int) -> np.ndarray:
    """Vectors of one dimension, from their bytes, as rows of doubles."""
    data = list(data)
    width = "<f4" if data and len(data[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(data), width).astype(np.float64).reshape(len(data), dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow of large components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample(vectors: DataFrame, size: int) -> dict[int, np.ndarray]:
    """About `size` vectors of each dimension, of distinct id and content, as matrices on the driver, at least one and at most twice as many."""
    some = shared.distinct_sample(vectors.where("_vec is not null"), ["vec_id", "_vec"], size, "_dim").select("_dim", "_vec")
    rows = sorted((r[0], bytes(r[1])) for r in some.collect())
    return {d: matrix([v for k, v in rows if k == d], d) for d in sorted({k for k, _ in rows})}


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of plain k-means; an empty centre moves to the point that is worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * x @ centres.T
        near = far.argmin(1)
        for c in range(len(centres)):
            mine = x[near == c]
            centres[c] = mine.mean(0) if len(mine) else x[(far.min(1) + (x**2).sum(1)).argmax()]
    return centres
