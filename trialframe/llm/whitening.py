"""Whitening of embeddings from an exact covariance, summed over bit planes."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fixed point of an entry c: floor(SCALE * c) + SHIFT; further out than LARGEST it stays there.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 62
#: Components returned, rows whose bits are packed into words together, and rows of one task's Arrow slice.
COMPONENTS, BLOCK, SLICE = 16, 4096, 4096
#: Sums leave a task as high * 2^LIMB + low, so that Spark adds them exactly in decimals.
LIMB = 56
#: Lengths of vectors up to which tasks get all models at once; beyond that each row is joined with its own.
FEW = 64


def fixed_point(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, _dim, _x): entries as integers, 4 bytes each if all of a row fit, else 8.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out.
    """

    def rows(batches):
        for batch in shared.in_slices(batches, SLICE):
            lists, ids = batch["_v"], batch["vec_id"]
            flat, edges = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            finite = np.concatenate(([0], np.cumsum(np.isfinite(flat))))
            dims = np.diff(edges)
            good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (dims > 0) & (finite[edges[1:]] - finite[edges[:-1]] == dims))
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(flat * SCALE)
                x = np.where(np.abs(scaled) < LARGEST, scaled, np.sign(scaled) * LARGEST)
            x = np.where(np.isfinite(x), x, 0).astype(np.int64) + SHIFT
            small = np.concatenate(([0], np.cumsum(np.abs(x) < 1 << 31)))
            data = [x[i:j].astype("<i4" if small[j] - small[i] == j - i else "<i8").tobytes() for i, j in zip(edges[good], edges[good + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array(dims[good], pa.int32()), pa.array(data, pa.binary())], ["vec_id", "_dim", "_x"])

    source = embeddings.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("_v"))
    return source.mapInArrow(rows, "vec_id long, _dim int, _x binary")


def _matrix(data, dim: int) -> np.ndarray:
    """Rows of int64 from their bytes, of either width."""
    data = list(data)
    if all(len(b) == 4 * dim for b in data):
        return np.frombuffer(b"".join(data), "<i4").astype(np.int64).reshape(-1, dim)
    return np.stack([np.frombuffer(b, "<i4" if len(b) == 4 * dim else "<i8").astype(np.int64) for b in data])


def _with_models(rows: DataFrame, models: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[int, dict] | None]:
    """Rows, and the models of all lengths; or rows joined with their models, and None, if lengths abound."""
    few = models.select("_dim", *names).limit(FEW + 1).collect()
    if len(few) > FEW:
        return rows.join(models.select("_dim", *names), "_dim"), None
    return rows, {r["_dim"]: r.asDict() for r in few}


def _by_length(batches, known: dict[int, dict] | None = None, names: tuple[str, ...] = ()):
    """(length, rows as an Arrow batch, their x as a matrix, their model) of slices of Arrow batches."""
    for batch in shared.in_slices(batches, SLICE):
        dims = batch["_dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            model = {k: part[k][0].as_py() for k in names} if known is None else known[dim]
            yield dim, part, _matrix(part["_x"].to_pylist(), dim), model


def bit_planes(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers (rows x dimensions), across rows in 64-bit words.

    Plane by plane, dimension by dimension: the planes of dimension j follow those of j - 1, lowest first.
    """
    words = -(-len(shifted) // 64)
    of = np.repeat(np.arange(len(bits)), bits)
    place = np.arange(len(of)) - np.repeat(np.cumsum(bits) - bits, bits)
    bit = (shifted[:, of].astype(np.uint64) >> place.astype(np.uint64)) & np.uint64(1)
    packed = np.packbits(bit.astype(np.uint8), axis=0, bitorder="little")
    packed = np.concatenate([packed, np.zeros((8 * words - len(packed), len(of)), np.uint8)])
    return np.ascontiguousarray(packed.T).view("<u8")


def cross_products(shifted: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums per dimension and products per pair of dimensions (upper triangle), by AND and popcount.

    Two planes of weights 2^a and 2^b share popcount(plane & plane) rows, which add 2^(a + b) each.
    Integers stay in 64 bits where they fit there, else they become Python integers.
    """
    planes, first = bit_planes(shifted, bits), np.concatenate(([0], np.cumsum(bits)))
    d, of = len(bits), np.repeat(np.arange(len(bits)), bits)
    place = np.arange(len(of)) - first[of]
    wide = 2 * int(bits.max(initial=0)) + len(shifted).bit_length() > 62
    kind = object if wide else np.int64
    weight = np.array([1 << int(p) for p in place], kind)
    sums, cross = np.zeros(d, kind), np.zeros((d, d), kind)
    for p in range(len(planes)):
        i = of[p]
        counts = np.bitwise_count(planes[first[i] :] & planes[p]).sum(axis=1, dtype=np.int64).astype(kind)
        here = counts * weight[first[i] :]
        sums[i] += int(np.bitwise_count(planes[p]).sum(dtype=np.int64)) << int(place[p])
        np.add.at(cross[i], of[first[i] :], here * (1 << int(place[p])))
    return sums, cross


def _ranges(fit: DataFrame) -> DataFrame:
    """(_dim, lows, bits): least value of each dimension and bits of the values above it, a row per length of vectors."""

    def rows(batches):
        found = {}
        for dim, _, x, _ in _by_length(batches):
            low, high = found.get(dim, (x[0], x[0]))
            found[dim] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        for dim, (low, high) in found.items():
            yield pa.RecordBatch.from_pydict({"_dim": pa.array([dim] * dim, pa.int32()), "i": pa.array(range(dim), pa.int32()), "low": low, "high": high})

    ends = fit.mapInArrow(rows, "_dim int, i int, low long, high long").groupBy("_dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "low", "high")))
    return ends.groupBy("_dim").agg(ordered.alias("o")).select("_dim", F.col("o.low").alias("lows"), F.col("o.high").alias("highs"))


def _moments(fit: DataFrame, ranges: DataFrame) -> DataFrame:
    """(_dim, i, j, high, low): exact sums (j = -1) and cross-products of the values above the least ones.

    Each task adds its rows up by bit planes; what it returns has a row per pair of dimensions.
    """

    fit, known = _with_models(fit, ranges, ("lows", "highs"))

    def rows(batches):
        total = {}
        for dim, _, x, ends in _by_length(batches, known, ("lows", "highs")):
            low = np.array(ends["lows"], np.int64)
            bits = np.array([(h - m).bit_length() for h, m in zip(ends["highs"], ends["lows"], strict=True)])
            for at in range(0, len(x), BLOCK):
                sums, cross = cross_products(x[at : at + BLOCK].astype(np.uint64) - low.astype(np.uint64), bits)
                if dim not in total:
                    total[dim] = [0, np.zeros(dim, object), np.zeros((dim, dim), object)]
                total[dim][0] += len(x[at : at + BLOCK])
                total[dim][1] += sums
                total[dim][2] += cross
        for dim, (n, sums, cross) in total.items():
            i, j = np.triu_indices(dim)
            values = [n, *sums.tolist(), *cross[i, j].tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "_dim": pa.array([dim] * len(values), pa.int32()),
                    "i": pa.array([-1, *range(dim), *i.tolist()], pa.int32()),
                    "j": pa.array([-1] * (dim + 1) + j.tolist(), pa.int32()),
                    "high": pa.array([Decimal(v >> LIMB) for v in values], pa.decimal128(38, 0)),
                    "low": pa.array([v & ((1 << LIMB) - 1) for v in values], pa.int64()),
                }
            )

    parts = fit.mapInArrow(rows, "_dim int, i int, j int, high decimal(38,0), low long")
    return parts.groupBy("_dim", "i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))


def eigen_model(n: int, sums: list[int], cross: dict[tuple[int, int], int], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvectors (columns), their eigenvalues and the trace, of a covariance from exact sums.

    n * product - sum * sum is centred as an integer and divided once, so each entry is correctly
    rounded. The largest entry of a vector is positive.
    """
    d = len(sums)
    v = np.zeros((d, d))
    for (i, j), c in cross.items():
        v[i, j] = v[j, i] = (n * c - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    flat = values <= np.abs(values).max(initial=0) * d * np.finfo(float).eps
    return vectors, np.where(flat, 0.0, values), float(np.trace(v))


def fit_model(fit: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(_dim, n, lows, sums, axes, variances, trace): a row per length of vectors; sums are decimals as strings.

    axes holds the components one after the other. The matrix of one length is a single group: d * d / 2
    rows, however many vectors were added up.
    """
    ranges = shared.materialize(_ranges(fit), "whiten-ranges")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = {(i, j): (int(h) << LIMB) + int(m) for i, j, h, m in zip(pdf.i, pdf.j, pdf.high, pdf.low, strict=True)}
        n, dim = whole.pop((-1, -1)), int(pdf["_dim"].iloc[0])
        sums = [whole.pop((i, -1)) for i in range(dim)]
        axes, variances, trace = eigen_model(n, sums, whole, most)
        return pd.DataFrame({"_dim": [dim], "n": [n], "sums": [[str(s) for s in sums]], "axes": [axes.T.ravel()], "variances": [variances], "trace": [trace]})

    solved = _moments(fit, ranges).groupBy("_dim").applyInPandas(solve, "_dim int, n long, sums array<string>, axes array<double>, variances array<double>, trace double")
    return shared.materialize(solved.join(ranges.select("_dim", "lows"), "_dim"), "whiten-model")


def _centred(x: np.ndarray, n: int, lows: list[int], sums: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as exact integers (64 bits if they fit, else Python's), and x - S / n as doubles."""
    above, total = x.astype(np.uint64) - np.array(lows, np.int64).astype(np.uint64), [int(s) for s in sums]
    fits = 2 * (n * (int(above.max(initial=0)) + 1)).bit_length() + x.shape[1].bit_length() < 62
    kind = np.int64 if fits else object
    exact = above.astype(kind) * n - np.array(total, kind)
    return exact, (exact / n).astype(float)


def _projected(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared deviations of rows (exact) and their whitened coordinates, NaN along axes without variance."""
    exact, centred = _centred(x, model["n"], model["lows"], model["sums"])
    variances = np.array(model["variances"])
    axes = np.array(model["axes"]).reshape(len(variances), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        whitened = np.where(variances > 0, centred @ axes.T / np.sqrt(variances), np.nan)
    return (exact * exact).sum(axis=1), whitened


MODEL = ("n", "lows", "sums", "axes", "variances")


def identity_errors(fit: DataFrame, model: DataFrame) -> DataFrame:
    """(_dim, identity_error): largest entry of the fit list's whitened covariance less the identity.

    Measured on the whitened rows themselves: each task returns sums and products of the few components.
    Axes without variance are left out; with none at all the error is 0.
    """

    fit, known = _with_models(fit, model, MODEL)

    def rows(batches):
        total = {}
        for dim, _, x, one in _by_length(batches, known, MODEL):
            w = _projected(x, one)[1]
            w = np.column_stack([np.ones(len(w)), np.nan_to_num(w)])
            total[dim] = total.get(dim, 0) + w.T @ w
        for dim, s in total.items():
            i, j = np.indices(s.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"_dim": pa.array([dim] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": s.ravel()})

    def largest(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.i.max()) + 1
        s = np.zeros((k, k))
        s[pdf.i, pdf.j] = pdf.s
        s /= s[0, 0]
        cov, used = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]), s.diagonal()[1:] > 0
        apart = np.abs(cov - np.eye(k - 1))[np.ix_(used, used)]
        return pd.DataFrame({"_dim": [int(pdf["_dim"].iloc[0])], "identity_error": [float(apart.max(initial=0.0))]})

    parts = fit.mapInArrow(rows, "_dim int, i int, j int, s double")
    return parts.groupBy("_dim", "i", "j").agg(F.sum("s").alias("s")).groupBy("_dim").applyInPandas(largest, "_dim int, identity_error double")


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable row along the leading components: vec_id, n, deviation, whitened, explained, identity_error.

    whitened and explained are arrays, one value per component, by falling eigenvalue. deviation, the sum
    over dimensions of (n * x - S)^2, is an exact integer as a string, since it outgrows 64 bits at some n.

    The fit list holds each distinct x vector once, so copies neither weigh more nor gather in one task.
    Rows with a null, empty or not wholly finite vector are left out; entries beyond 2^62 after scaling stay
    there. Vectors of each length are whitened by themselves. Along an axis without variance whitened is null;
    explained is null where there is no variance at all. A null vec_id stays null; repeated rows come out
    as often as they come in; an empty table gives no rows; other columns are ignored. Models have
    a few thousand numbers for each length of vectors; tasks get them with their code while there are few
    lengths, and by a join otherwise.
    """
    rows = fixed_point(embeddings, column)
    fit = shared.materialize(rows.select("_dim", "_x").distinct(), "whiten-fit")
    model = fit_model(fit, components)
    errors = identity_errors(fit, model)
    names = (*MODEL, "trace", "identity_error")
    rows, known = _with_models(rows, model.join(errors, "_dim"), names)

    def project(batches):
        for _, part, x, one in _by_length(batches, known, names):
            squares, w = _projected(x, one)
            shares = [float(v) / one["trace"] if one["trace"] > 0 else None for v in one["variances"]]
            k, size = w.shape[1], len(w)
            yield pa.RecordBatch.from_arrays(
                [
                    part["vec_id"], pa.array([one["n"]] * size, pa.int64()), pa.array([str(s) for s in squares.tolist()]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, size * k + 1, k), pa.int32()), pa.array(w.ravel(), from_pandas=True)),
                    pa.array([shares] * size, pa.list_(pa.float64())), pa.array([one["identity_error"]] * size, pa.float64()),
                ],
                ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, "vec_id long, n long, deviation string, whitened array<double>, explained array<double>, identity_error double")


def by_component(whitened: DataFrame) -> DataFrame:
    """A row per vector and component (from 1); a deviation that no long holds is null."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "v")
    return whitened.select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error",
    )
