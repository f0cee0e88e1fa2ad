"""Near-duplicate embeddings: int8 tile products with exact error bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors
from .components import components, merge_labels

COSINE = 0.9
#: Vectors in a block (a tile compares two blocks), and pairs recomputed at a time.
BLOCK, RECOMPUTE = 2048, 50_000
#: Directions against which whole tiles are ruled out, fitted to a sample of that many vectors.
PIVOTS, SAMPLE = 16, 4096


def quantise(unit: np.ndarray):
    """int8 codes, scale, length of the coded vector and of the residual, for each row."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, cosine: float, same: bool):
    """All (i, j) with cosine(a[i], b[j]) >= cosine in double precision; i < j if same.

    With unit vectors x = x' + r and y = y' + s, x' and y' being the coded ones, x.y differs from
    x'.y' by at most |x'||s| + |r||y'| + |r||s|. Only pairs whose bound reaches the threshold are
    recomputed from the original components. Products of int8 codes are whole numbers below 2**24
    for up to 1040 dimensions, which single precision holds exactly.
    """
    exact = np.float32 if a.shape[1] <= 1040 else np.float64
    (qa, sa, la, ra), (qb, sb, lb, rb) = quantise(vectors.unit(a)), quantise(vectors.unit(b))
    product = qa.astype(exact) @ qb.astype(exact).T
    slack = la.max() * rb.max() + ra.max() * lb.max() + ra.max() * rb.max() + 1e-9
    near = product >= (1 / sa)[:, None].astype(exact) * ((cosine - slack) / sb * (1 - 1e-6 * np.sign(cosine - slack))).astype(exact)
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    bound = product[i, j] * sa[i] * sb[j] + la[i] * rb[j] + ra[i] * (lb[j] + rb[j]) + 1e-9
    i, j = i[bound >= cosine], j[bound >= cosine]
    big_a, big_b = np.abs(a).max(1, keepdims=True), np.abs(b).max(1, keepdims=True)
    a, b = a / big_a, b / big_b
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    keep = [np.einsum("ij,ij->i", a[i[k : k + RECOMPUTE]], b[j[k : k + RECOMPUTE]]) / (na[i[k : k + RECOMPUTE]] * nb[j[k : k + RECOMPUTE]]) >= cosine for k in range(0, len(i), RECOMPUTE)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _tile(cosine: float):
    """Links of two blocks as at most one row per vector: links with it, and the smallest row linked so far."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns=lambda c: c.removeprefix("r_"))
        same = left["block"].iloc[0] == right["block"].iloc[0]
        both = left if same else pd.concat([left, right], ignore_index=True)
        rows = both["row_no"].to_numpy()
        order = np.argsort(rows, kind="stable")
        both, rows = both.iloc[order], rows[order]
        copies, side, dims = both["copies"].to_numpy(), both["block"].to_numpy() == left["block"].iloc[0], both["_dim"].to_numpy()
        label, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for d in np.unique(dims[side]):
            x = np.flatnonzero(side & (dims == d))
            y = x if same else np.flatnonzero(~side & (dims == d))
            if not len(y):
                continue
            i, j = tile_links(vectors.matrix(both["_vec"].iloc[x], d), vectors.matrix(both["_vec"].iloc[y], d), cosine, same)
            i, j = x[i], y[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            merge_labels(label, i, j)
        found = links > 0
        return pd.DataFrame({"node": rows[found], "n": links[found], "other": rows[label[found]]})

    return run


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _tiles(blocks: DataFrame, widest: float) -> DataFrame:
    """(block, second) of all pairs of blocks, block <= second, that may hold vectors within the angle `widest`.

    Two vectors within that angle have angles to any pivot that differ by no more. So blocks meet by
    an equi-join on the pivot next to the first block and on ranges of `widest` of the angle to it, in
    the first range that both reach; all other pivots are then checked. A block of several dimensions
    (no more than there are dimensions) meets every block.
    """
    pure = blocks.where("_dim >= 0")
    cut = lambda x: F.floor(x / F.lit(widest))
    left = pure.withColumn("c", (F.array_position("low", F.array_min("low")) - 1).cast("int")).select(
        "block", F.col("_dim").alias("dim"), "low", "high", "c", cut(F.get("low", "c") - widest).alias("from"), cut(F.get("high", "c") + widest).alias("to")
    )
    left = left.withColumn("b", F.explode(F.sequence("from", "to")))
    right = pure.select(F.col("block").alias("second"), F.col("_dim").alias("dim"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.posexplode(F.arrays_zip("low", "high")).alias("c", "z"))
    right = right.withColumn("from2", cut(F.col("z.low"))).withColumn("b", F.explode(F.sequence("from2", cut(F.col("z.high")))))
    near = left.join(right, ["dim", "c", "b"]).where("second >= block and b = greatest(`from`, from2)")
    apart = F.expr(f"exists(arrays_zip(low, high, low2, high2), z -> z.low - z.high2 > {widest!r} or z.low2 - z.high > {widest!r})")
    # the pivot next to the second block may lie elsewhere, but what it rules out is ruled out by `apart`
    near = near.where(~apart).select("block", "second")
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    mixed = blocks.where("_dim < 0").select(F.col("block").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("o"))
    return near.union(mixed.select(F.least("m", "o"), F.greatest("m", "o"))).distinct()


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links are pairs of cosine >= cosine (above 0).

    Equal vectors become one row with a count first, so copies never form pairs; they count as
    linked. The distinct vectors are laid out by their nearest pivot and cut into equal blocks, and
    every two blocks are compared in a tile, except those that the triangle inequality of angles
    rules out against some pivot. A tile returns link counts and a spanning forest, one row per
    vector at most, never its pairs. Vectors of different dimensions, and vectors that are null, zero
    or hold null or non-finite components, link with nothing. Rows that repeat a vec_id are vectors
    of their own; null ids are never a component's id unless it has no other.
    """
    rows = shared.materialize(vectors.as_bytes(embeddings), "dedup-vectors")
    distinct = rows.where("_vec is not null").groupBy("_vec", "_dim").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    pivots = {d: vectors.unit(vectors.k_means(vectors.unit(x), min(PIVOTS, len(x))) + 1e-12) for d, x in vectors.sample(rows, SAMPLE).items()}

    def place(frames):
        for f in frames:
            cell, near = np.zeros(len(f), np.int32), np.zeros(len(f))
            for d in f["_dim"].unique():
                at = np.flatnonzero(f["_dim"] == d)
                angle = _angles(vectors.unit(vectors.matrix(f["_vec"].iloc[at], d)), pivots[d])
                cell[at], near[at] = angle.argmin(1), angle.min(1)
            yield f.assign(cell=cell, near=near)

    placed = distinct.mapInPandas(place, "_vec binary, _dim int, least long, copies long, cell int, near double")
    order = [F.col(c) for c in ("_dim", "cell", "near", "_vec")]
    placed = shared.with_row_numbers(shared.materialize(placed, "dedup-distinct"), order, "dedup-order").withColumn("block", (F.col("row_no") / BLOCK).cast("int"))
    placed = placed.select("row_no", "block", "_dim", "_vec", "least", "copies")

    def reach(f: pd.DataFrame) -> pd.DataFrame:
        """The angles to each pivot that the vectors of a block have; all angles if dimensions mix."""
        d = f["_dim"].iloc[0]
        if (f["_dim"] != d).any():
            return pd.DataFrame({"block": [f["block"].iloc[0]], "_dim": [-1], "low": [[]], "high": [[]]})
        angle = _angles(vectors.unit(vectors.matrix(f["_vec"], d)), pivots[d])
        return pd.DataFrame({"block": [f["block"].iloc[0]], "_dim": [d], "low": [angle.min(0).tolist()], "high": [angle.max(0).tolist()]})

    blocks = placed.groupBy("block").applyInPandas(reach, "block int, _dim int, low array<double>, high array<double>")
    blocks = shared.materialize(blocks, "dedup-blocks")
    tiles = shared.materialize(_tiles(blocks, math.acos(cosine) + 1e-6), "dedup-tiles")
    left = placed.join(tiles, "block").withColumnRenamed("second", "pair")
    right = placed.join(tiles.select(F.col("block").alias("first"), F.col("second").alias("block")), "block")
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])  # both sides are the same table
    sides = left.groupBy("block", "pair").cogroup(right.groupBy("r_first", "r_block"))
    links = shared.materialize(sides.applyInPandas(_tile(cosine), "node long, n long, other long"), "dedup-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("links"))
    classes = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), "dedup-classes").withColumnRenamed("node", "member")
    named = placed.select("row_no", "_vec", "least", "copies").join(counts, F.col("row_no") == F.col("node"), "left").join(classes, F.col("row_no") == F.col("member"), "left")
    named = named.select("_vec", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "row_no").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "label").select(F.col("_vec").alias("v"), "links", F.col("component_id").alias("c"))
    out = rows.join(named, F.col("_vec") == F.col("v"), "left")
    component = F.when(F.col("_vec").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
