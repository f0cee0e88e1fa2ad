import numpy as np
import pytest
from test_components import brute

from trialframe.llm import ann, embedding_dedup
from trialframe.llm import vectors as llm_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, block string"


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(1, n // 3), dim)).astype(np.float32)
    x = base[rng.integers(0, len(base), n)] + 0.12 * rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 5] = x[n // 2]  # a group of copies
    return x


def odd(dim=16):
    return [
        (None, [1.0] * dim), (5000, None), (5001, []), (5002, [0.0] * dim), (5003, [float("nan")] * dim), (5004, [1.0, None] + [0.0] * (dim - 2)),
        (5005, [float("inf")] * dim), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [3e38] * dim), (5008, [3e38] * dim), (5100, [1e-38] * dim), (5200, [3.0, 1.0]),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def slow_links(rows, cosine=0.9):
    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    edges = []
    for k, i in enumerate(good):
        x = np.array(rows[i][1], np.float32).astype(float)
        for j in good[:k]:
            y = np.array(rows[j][1], np.float32).astype(float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                edges.append((i, j))
    root = brute(edges + [(i, i) for i in range(len(rows))])
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((vec, sum(i in e for e in edges), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    n = 60 if block == 7 else 260
    rows = [(i * 3, v) for i, v in enumerate(vectors(n).tolist())] + odd()
    got = embedding_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == slow_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bounds_hold():
    x = vectors(300, 64, 5).astype(float)
    i, j = embedding_dedup.tile_links(x, x, 0.9, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(np.triu(u @ u.T >= 0.9, 1))), strict=True))
    codes, scale, coded, rest = embedding_dedup.quantise(u)
    q = codes * scale[:, None]
    assert (np.abs(u @ u.T - q @ q.T) <= coded[:, None] * rest + rest[:, None] * (coded + rest) + 1e-12).all()


def test_nothing_to_compare(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0
    got = embedding_dedup.near_duplicates(frame(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def slow_search(rows, k=10):
    out = []
    for q, v in rows:
        if q is None or q % 100 or not usable(v):
            continue
        x = np.array(v, np.float32).astype(float)
        far = [(float(np.sqrt(((np.array(w, np.float32).astype(float) - x) ** 2).sum())), i) for i, w in rows if i is not None and i != q and usable(w) and len(w) == len(v)]
        out += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(sorted(far)[:k])]
    return sorted(out)


def recall(got, want):
    mine = {(r.query_id, r.vec_id) for r in got}
    return sum((q, i) in mine for q, _, i, _ in want) / max(1, len(want))


def test_search_small_is_exact(spark):
    rows = [(i * 20, v) for i, v in enumerate(vectors(150).tolist())] + [r for r in odd() if r[0] != 5008]
    got = ann.search(frame(spark, rows)).collect()
    assert [(a, b, c) for a, b, c, _ in slow_search(rows)] == sorted((r.query_id, r["rank"], r.vec_id) for r in got)
    want = {(a, c): d for a, _, c, d in slow_search(rows)}
    assert all(r.score == pytest.approx(want[r.query_id, r.vec_id], rel=1e-12) for r in got)


def test_search_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rows = [(i * 2, v) for i, v in enumerate(vectors(3000, 32, 3).tolist())]
    got = ann.search(frame(spark, rows)).collect()
    assert recall(got, slow_search(rows)) >= 0.95
    assert ann.search(frame(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "copies", "plain"])
def test_search_at_production_settings(spark, kind):
    """A full block: 40 clusters, a third of all rows near copies of one vector, or no structure."""
    rng = np.random.default_rng(11)
    n, dim = ann.BLOCK, 64
    x = rng.standard_normal((n, dim))
    if kind == "clusters":
        x = rng.standard_normal((40, dim))[rng.integers(0, 40, n)] + 0.3 * x
    if kind == "copies":
        x[: n // 3] = x[0] + 1e-3 * x[: n // 3]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x = x.astype(float)
    for q in range(0, n, 1000):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(n), far))[:10].tolist()


def test_fitting_sample_is_bounded(spark):
    df = frame(spark, [(i, [1.0] * 4) for i in range(900)])
    found = llm_vectors.sample(llm_vectors.as_bytes(df), 50)
    assert list(found) == [4] and 1 <= len(found[4]) <= 100


def test_tiles_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    mid, width = rng.uniform(0, 3, (30, 5)), rng.uniform(0, 0.4, (30, 5))
    low, high = np.maximum(mid - width, 0), mid + width
    rows = [(i, 8 if i < 29 else -1, low[i].tolist() if i < 29 else [], high[i].tolist() if i < 29 else []) for i in range(30)]
    blocks = spark.createDataFrame(rows, "block int, _dim int, low array<double>, high array<double>")
    for widest in (0.2, 0.45):
        near = lambda i, j: max(i, j) == 29 or ((low[i] - high[j] <= widest) & (low[j] - high[i] <= widest)).all()  # noqa: E731, B023
        want = {(i, j) for i in range(30) for j in range(i, 30) if near(i, j)}
        assert {tuple(r) for r in embedding_dedup._tiles(blocks, widest).collect()} == want


def test_registered_queries(spark):
    from trialframe.llm.queries import op2_anisotropic_search, op5_int8_tile_dedup

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    out = op2_anisotropic_search(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert sorted(tuple(r)[:3] for r in out.collect()) == [r[:3] for r in slow_search(rows)]
    out = op5_int8_tile_dedup(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str) == slow_links(rows)


def test_search_recall_on_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert recall(ann.search(table).collect(), slow_search(rows)) >= 0.95


def test_anisotropic_loss_beats_plain_on_parallel_error():
    x = vectors(2000, 64, 9).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, aware = ann.Quantiser.fit(x, weight=1.0), ann.Quantiser.fit(x)
    parallel = lambda m: np.abs(((x - m.decode(m.encode(x))) * x).sum(1)).mean()
    assert parallel(aware) < parallel(plain)


def test_sample_with_a_hot_row(spark):
    """One row repeated ten thousand times counts once; the others are drawn as if it were not there."""
    hot = spark.range(10_000).selectExpr("7L AS vec_id", "array(1D, 2D) AS embedding")
    rest = spark.range(300).selectExpr("id + 100 AS vec_id", "array(cast(id AS double), 1D) AS embedding")
    found = llm_vectors.sample(llm_vectors.as_bytes(hot.union(rest)), 100)[2]
    assert 60 <= len(found) <= 200 and sum((v == [1.0, 2.0]).all() for v in found.tolist() and found) <= 1
    assert len(llm_vectors.sample(llm_vectors.as_bytes(hot), 100)[2]) == 1


@pytest.mark.parametrize("scales", [[1e-160], [1e-30], [1e20], [1e150], [1e-160, 1e-30, 1.0, 1e20, 1e150]])
def test_search_at_any_finite_scale(spark, scales):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6)) * np.resize(scales, 400)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, rerank=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 100):
        top = np.abs(x - x[q]).max(1)
        far = top * np.sqrt((((x - x[q]) / np.maximum(top, 1e-300)[:, None]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(400), far))[:10]
        assert np.allclose([s for _, _, s in sorted(got[q])], far[best], rtol=1e-9, atol=0) and len(scales) > 1 or [v for _, v, _ in sorted(got[q])] == best.tolist()
