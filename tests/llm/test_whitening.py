"""Whitening against sums of Python integers and plain eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from trialframe.llm import whitening

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.StringType()), T.StructField("_dim", T.StringType())]
)


def made(spark, rows):
    return spark.createDataFrame([(i, v, "n", "d") for i, v in rows], SCHEMA)


def slow(rows, most=16):
    """{vec_id: [(deviation, |whitened| per component)]}, n, explained; vectors of one length."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit), n**3)) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    out = []
    for (i, _), r in zip(good, x, strict=True):
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(r, s, strict=True)])
        out.append((i, sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)), centred @ w / np.sqrt(e)))
    return out, n, e / np.trace(cov)


def compare(got, rows, most=16):
    want, n, explained = slow(rows, most)
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(want) * len(explained)
    signs = None
    for i, deviation, w in sorted(want, key=lambda t: -abs(t[2]).min()):
        by = seen[i, deviation]
        found = np.array([by[k + 1][0].whitened for k in range(len(w))])
        signs = np.sign(found * w) if signs is None else signs
        assert np.allclose(found, w * signs, atol=1e-7)
        for k, rs in by.items():
            assert all(r.n == n and abs(r.explained / explained[k - 1] - 1) < 1e-9 and r.identity_error < 1e-8 for r in rs)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    from trialframe.llm.queries import QUERIES

    compare(QUERIES["op11_bitsliced_whitening"](spark, path).collect(), [(r.vec_id, list(r.embedding)) for r in e.collect()])


def test_cross_products_are_exact():
    rng = np.random.default_rng(3)
    for bits in ([9, 1, 0, 12], [40, 3, 63, 0]):
        x = np.stack([rng.integers(0, 1 << b, 150, dtype=np.uint64, endpoint=False) if b else np.zeros(150, np.uint64) for b in bits], 1)
        sums, cross = whitening.cross_products(x, np.array(bits))
        plain = x.astype(object)
        assert sums.tolist() == plain.sum(0).tolist()
        whole = plain.T @ plain
        assert all(cross[i, j] == whole[i, j] for i in range(4) for j in range(i, 4))
        assert np.array_equal(sum(np.unpackbits(p.view(np.uint8)).sum(dtype=int) << k for k, p in enumerate(whitening.bit_planes(x[:, :1], np.array(bits[:1])))), plain[:, 0].sum())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(1, rows[1][1]), (2, rows[2][1]), (None, rows[3][1])] + [(500 + i, rows[7][1]) for i in range(200)]
    rows += [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [math.nan] * 5), (93, [math.inf, 0.0, 0.0, 0.0, 0.0]), (94, []), (95, [0.0] * 5)]
    compare(whitening.by_component(whitening.whiten(made(spark, rows))).collect(), rows)


def test_large_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * [1e13, 1e3, 1.0]).tolist()) for i in range(50)]
    got = whitening.whiten(made(spark, rows)).collect()
    want = {i: d for i, d, _ in slow(rows)[0]}
    assert {r.vec_id: int(r.deviation) for r in got} == want
    assert all(r.deviation is None or r.deviation < 1 << 63 for r in whitening.by_component(whitening.whiten(made(spark, rows))).collect())
    assert whitening.whiten(made(spark, rows + [(99, [1e300, -1e300, 0.0])])).count() == 51


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing(spark, rows):
    assert whitening.by_component(whitening.whiten(made(spark, rows))).collect() == []


def test_no_variance_and_several_lengths(spark):
    got = whitening.by_component(whitening.whiten(made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [2.0])]))).collect()
    two = [r for r in got if r.vec_id in (1, 2)]
    assert all(r.whitened is None and r.explained is None and r.n == 1 and r.deviation == 0 and r.identity_error == 0 for r in two) and len(two) == 4
    one = sorted((r.vec_id, r.whitened) for r in got if r.vec_id > 2)
    assert [i for i, _ in one] == [3, 4] and abs(abs(one[0][1]) - 1) < 1e-12 and one[0][1] == -one[1][1]
    flat = whitening.by_component(whitening.whiten(made(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0])]))).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}


def test_many_lengths(spark):
    rows = [(i, [float(j * j % (i % 70 + 2)) for j in range(1 + i % 70)]) for i in range(140)]
    got = whitening.by_component(whitening.whiten(made(spark, rows))).collect()
    assert len(got) == sum(min(16, len(v)) for _, v in rows)
