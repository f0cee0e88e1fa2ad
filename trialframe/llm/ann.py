"""Nearest-neighbour search: anisotropic four-bit product quantisation with exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared, vectors

#: Neighbours returned, candidates reranked first for each query and block, and vectors the codebooks are fitted to.
NEIGHBOURS, RERANK, SAMPLE = 10, 150, 8192
#: Vectors in a block and queries in a block; one task scans one by the other.
BLOCK, QUERIES = 16_384, 8192
#: Vectors measured exactly at a time.
SLICE = 4096
#: Dimensions of a subspace, and the inner product (as a part of the largest) above which errors matter most.
SUB, MATTERS = 2, 0.2


class Quantiser:
    """Codebooks of 16 centres per subspace under a score-aware loss.

    For large inner products, the error of a score comes mostly from the part of the residual that is
    parallel to the vector. So the loss is |r|^2 + (weight - 1) (r . x / |x|)^2, the weight following
    from the dimension and the score threshold. Codes are found by going over the subspaces in turn,
    each time choosing the centre with the least loss given the others; centres are the weighted
    least squares solution for their members. All of it happens on vectors times `unit`, a power of two that
    brings the sample's largest component near 1.
    """

    def __init__(self, centres: np.ndarray, dim: int, weight: float, unit: float = 1.0):
        self.centres, self.dim, self.weight, self.unit = centres, dim, weight, unit

    @staticmethod
    def _cut(x: np.ndarray) -> np.ndarray:
        """Rows as (rows, subspaces, SUB); padded so that two codes fill each byte."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB)))).reshape(len(x), -1, SUB)

    @classmethod
    def fit(cls, x: np.ndarray, weight: float | None = None, rounds: int = 5) -> Quantiser:
        dim = x.shape[1]
        if weight is None:
            weight = max(1.0, (dim - 1) * MATTERS**2 / (1 - MATTERS**2))
        unit = _unit(x)
        x = x * unit
        parts = cls._cut(x)
        centres = np.stack([np.resize(vectors.k_means(parts[:, m], 16, 5, seed=m), (16, SUB)) for m in range(parts.shape[1])])
        model = cls(centres, dim, weight, unit)
        for _ in range(rounds):
            codes = model._codes(x)
            model._refit(x, codes)
        return model

    def _codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        parts = self._cut(x)
        along = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        cost = lambda m: ((parts[:, m, None] - self.centres[m]) ** 2).sum(2)
        ahead = lambda m: ((parts[:, m, None] - self.centres[m]) * along[:, m, None]).sum(2)
        codes = np.stack([cost(m).argmin(1) for m in range(parts.shape[1])], 1)
        rows = np.arange(len(x))
        total = sum(ahead(m)[rows, codes[:, m]] for m in range(parts.shape[1]))
        for _ in range(sweeps if self.weight > 1 else 0):
            for m in range(parts.shape[1]):
                step = ahead(m)
                rest = total - step[rows, codes[:, m]]
                codes[:, m] = (cost(m) + (self.weight - 1) * (rest[:, None] + step) ** 2).argmin(1)
                total = rest + step[rows, codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        parts = self._cut(x)
        along = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        more, rows = self.weight - 1, np.arange(parts.shape[1])
        for m in rows:
            residual = ((parts - self.centres[rows, codes]) * along).sum(2)
            rest = residual.sum(1) - residual[:, m]
            for c in range(16):
                mine = codes[:, m] == c
                if not mine.any():
                    continue
                p, a = parts[mine, m], along[mine, m]
                left = mine.sum() * np.eye(SUB) + more * a.T @ a
                self.centres[m, c] = np.linalg.solve(left, p.sum(0) + more * (a * (rest[mine] + (p * a).sum(1))[:, None]).sum(0))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes in each byte."""
        with np.errstate(over="ignore", invalid="ignore"):  # far beyond the sample any code will do: bounds use the residual
            codes = self._codes(x * self.unit).astype(np.uint8)
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """Coded vectors, times unit."""
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)
        return self.centres[np.arange(codes.shape[1]), codes].reshape(len(packed), -1)[:, : self.dim]

    def tables(self, query: np.ndarray, scale: float) -> np.ndarray:
        """Inner products of a query with every centre times scale; the tables of two subspaces joined, one entry a byte."""
        each = np.einsum("mcs,ms->mc", self.centres * scale, self._cut(query[None])[0])
        return (each[0::2, :, None] + each[1::2, None, :]).reshape(len(each) // 2, 256).astype(np.float32)


def _unit(*arrays: np.ndarray) -> float:
    """The power of two that brings the largest component near 1, as far as doubles reach."""
    top = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 2.0 ** min(1000, -int(np.floor(np.log2(top)))) if top else 1.0


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray, score: np.ndarray, lower: np.ndarray, k: int, rerank: int):
    """Rows of the k nearest of x to q, nearest first, and their distances, measured exactly.

    The `rerank` rows of the best scores are measured first; then all others whose lower bound does
    not exceed the k-th distance found so far, in slices by rising bound. So none is missed.
    """

    def measured(rows):
        apart = x[rows] - q
        power = np.frexp(np.abs(apart).max(1))[1]  # squares of components near 1 stay in range, and powers of two are exact
        return np.ldexp(np.sqrt((np.ldexp(apart, -power[:, None]) ** 2).sum(1)), power)

    def keep(rows, far):
        first = np.lexsort((ids[rows], far))[:k]
        return rows[first], far[first]

    rows = np.flatnonzero(allowed)
    if len(rows) > rerank:
        rows = rows[np.argpartition(-score[rows], rerank)[:rerank]]
    left = allowed.copy()
    left[rows] = False
    rows, far = keep(rows, measured(rows))
    more = np.flatnonzero(left & (lower <= far[-1])) if len(far) == k else np.flatnonzero(left)
    more = more[np.argsort(lower[more], kind="stable")]
    for i in range(0, len(more), SLICE):
        some = more[i : i + SLICE]
        some = some[lower[some] <= far[-1]] if len(far) == k else some
        if not len(some):
            break
        rows, far = keep(np.concatenate([rows, some]), np.concatenate([far, measured(some)]))
    return rows, far


def _scan(models: dict, k: int, rerank: int):
    """Nearest k of one block of vectors for one block of queries."""

    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        base = base.sort_values("vec_id", kind="stable") if len(queries) else base.iloc[:0]
        for d in queries["_dim"].unique() if len(base) else []:
            part, asked = base[base["_dim"] == d], queries[queries["_dim"] == d]
            if not len(part):
                continue
            x, ids, queried = vectors.matrix(part["_vec"], d), part["vec_id"].to_numpy(), vectors.matrix(asked["_vec"], d)
            packed = np.frombuffer(b"".join(part["_codes"]), np.uint8).reshape(len(part), -1)
            coded, unit = models[d].decode(packed), models[d].unit
            # bounds are made of numbers near 1, so that squares and single-precision tables do not overflow
            scale = min(_unit(x, queried), _unit(coded) * unit)
            near, coded = x * scale, coded * (scale / unit)
            packed, half = packed.T.copy(), (near**2).sum(1) / 2
            rest, size = np.linalg.norm(near - coded, axis=1), np.linalg.norm(coded, axis=1)
            for query, q in zip(asked["query_id"], queried, strict=True):
                product = np.zeros(len(x), np.float32)
                for table, codes in zip(models[d].tables(q * scale, scale / unit), packed, strict=True):
                    product += table[codes]
                # |q - x| >= |q - coded| - |x - coded|; sums of single precision err by no more than slack
                product, length = product.astype(np.float64), np.linalg.norm(q * scale)
                slack = (len(packed) + 2) * (2.0**-23 * length * size + 2.0**-120)  # relative, and below the least normal numbers
                lower = np.sqrt(np.maximum((length - size) ** 2 * (1 - 1e-9), length**2 - 2 * product + size**2 - 2 * slack)) - rest
                lower = (lower - 1e-9 * (length + size + rest) - 2.0**-500) / scale
                rows, far = _nearest(q, x, ids, ids != query, product - half, lower, k, rerank)
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[rows], "score": far}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(embeddings: DataFrame, every: int = 100, k: int = NEIGHBOURS, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors, by Euclidean distance, of every query.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's
    own id. Each block of vectors is scanned for each block of queries by four-bit tables; the best
    `rerank` of a block are measured exactly, then all that by the codes and the lengths of their
    residuals may be as near as the k-th of these, so the result is that of a full search. A block's
    nearest k go on. Memory is that of two blocks, and each query's rows of the final ranking are k
    per block. Only vectors of equal dimension are
    compared; unusable vectors and null ids take no part. Of rows that repeat a query's id the
    smallest vector asks; repeated candidates each take a place. Codebooks are fitted to a bounded
    sample (SAMPLE); all vectors are encoded and scanned.
    """
    rows = shared.materialize(vectors.as_bytes(embeddings).where("_vec is not null and vec_id is not null"), "ann-vectors")
    models = {d: Quantiser.fit(x) for d, x in vectors.sample(rows, SAMPLE).items()}

    def encode(frames):
        for f in frames:
            codes = pd.Series([b""] * len(f), index=f.index, dtype=object)
            for d in f["_dim"].unique():
                at = f.index[f["_dim"] == d]
                codes[at] = [c.tobytes() for c in models[d].encode(vectors.matrix(f.loc[at, "_vec"], d))]
            yield f.assign(_codes=codes)

    asking = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("_vec", "_dim")).alias("v"))
    asking = asking.select("query_id", "v._vec", "v._dim")
    blocks, query_blocks = max(1, -(-rows.count() // BLOCK)), max(1, -(-asking.count() // QUERIES))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.mapInPandas(encode, "vec_id long, _vec binary, _dim int, _codes binary")
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "_vec"), F.lit(blocks)).cast("int")).withColumn("asked", every_of(query_blocks))
    asking = asking.withColumn("asked", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("block", every_of(blocks))
    near = base.groupBy("block", "asked").cogroup(asking.groupBy("block", "asked")).applyInPandas(_scan(models, k, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
