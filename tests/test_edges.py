"""Edge cases of the operators on hand-made cubes."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import svm
from trialframe.operators import decoding, features, folds, metrics, normalize, ranking, significance, weights
from trialframe.plans import statistics

EPS = 1e-12


def cube(spark, rows):
    return spark.createDataFrame(rows, "session string, cond int, trial int, frame int, pixel int, value double")


@pytest.mark.parametrize(("base", "want"), [(0.0, 1.0 / EPS), (EPS / 2, 1.0 / EPS), (-EPS / 2, 1.0 / EPS), (-EPS, None), (2.0, 0.5), (-2.0, -0.5)])
def test_frame_zero_near_zero(spark, base, want):
    got = normalize.frame_zero(cube(spark, [("a", 1, 0, 0, 0, base), ("a", 1, 0, 1, 0, 1.0)]), frames=[0]).where("frame = 1").first().value
    assert got == (pytest.approx(want) if want is not None else None)


def test_frame_list_differs_from_range(spark):
    c = cube(spark, [("a", 1, 0, f, 0, float(f + 1)) for f in range(6)])
    one = normalize.frame_zero(c, frames=[1, 4]).where("frame = 0").first().value
    two = normalize.frame_zero(c, frame_range=(1, 4)).where("frame = 0").first().value
    assert (one, two) == (pytest.approx(1 / 3.5), pytest.approx(1 / 3))
    with pytest.raises(ValueError):
        normalize.frame_zero(c)


def test_blank(spark):
    c = cube(spark, [("a", 3, 0, 0, 0, 0.0), ("a", 3, 1, 0, 0, float("nan")), ("a", 1, 0, 0, 0, 2.0), ("b", 1, 0, 0, 0, 2.0)])
    got = {(r.session, r.cond): r.value for r in normalize.blank(c, 3).where("trial = 0").collect()}
    assert got == {("a", 3): 0.0, ("a", 1): pytest.approx(2.0 / EPS), ("b", 1): None}
    assert [r.session for r in normalize.sessions_without_blank(c, 3).collect()] == ["b"]


def test_zscore_invariants(spark):
    rng = np.random.default_rng(0)
    c = cube(spark, [("a", 1, t, f, p, float(rng.normal(5, 2))) for t in range(5) for f in range(6) for p in range(3)])
    r = normalize.baseline_check(normalize.zscore_pooled(c, (0, 4)), (0, 4)).first()
    assert r.mean == pytest.approx(0, abs=1e-9) and r["std"] == pytest.approx(1)


def test_windows(spark):
    c = cube(spark, [("a", 1, 0, f, 0, 0.0) for f in range(10)])
    assert features.window_starts(256, 5, 1, 100) == (1, 95)
    first, last = features.window_starts(10, 4, 1, 10, 2)
    got = features.sliding_windows(c, 4, first, last, 2).groupBy("window").agg(F.sort_array(F.collect_list("frame")).alias("f")).orderBy("window").collect()
    assert [r.f for r in got] == [[s, s + 1, s + 2, s + 3] for s in range(1, 7, 2)]
    with pytest.raises(ValueError):
        features.window_starts(10, 4, 8, 10)
    with pytest.raises(ValueError):
        features.extract_window(c, 4, 11)


def test_balance_and_pairs(spark):
    t = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(7)], "trial int, y int")
    assert sorted(features.balanced(t).collect()) == [(0, 1, 0), (1, 1, 1), (2, 0, 2), (3, 0, 3)]
    pairs = folds.leave_pair_out(t).groupBy("fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert [(r.p, r.n) for r in pairs] == [(1, 2), (1, 2)]


def test_greedy_folds(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 1), (3, 1), (4, 7), (5, 4)], "trial int, n int")
    got = {r.trial: r.fold for r in folds.greedy_folds(sizes, 2).collect()}
    assert got == {1: 0, 4: 1, 5: 1, 2: 0, 3: 0} or sum(s for t, s in [(1, 10), (2, 1), (3, 1), (4, 7), (5, 4)] if got[t] == 0) in (11, 12)


PRED = "trial int, frame int, fold int, y_true int, y_pred int, score double"


def test_votes_and_auc(spark):
    p = spark.createDataFrame([(0, 0, 0, 1, 1, 0.5), (0, 1, 0, 1, 0, -0.5), (1, 0, 0, 0, 1, 0.5), (1, 1, 0, 0, 1, float("nan")), (2, 0, 1, 1, 1, 0.1)], PRED)
    vote = {r.trial: r.y_pred for r in metrics.majority_vote(p).collect()}
    assert vote == {0: 0, 1: 1, 2: 1}
    auc = {r.fold: r.auc for r in metrics.roc_auc(p, ("fold",)).collect()}
    assert auc == {0: pytest.approx(0.25), 1: None}
    summary = metrics.fold_summary(metrics.fold_metrics(p.where("fold = 1"))).first()
    assert summary.acc_std is None and summary.auc_mean is None


def test_constant_values(spark):
    w = spark.createDataFrame([(0, 2.0), (1, 2.0), (2, float("nan"))], "pixel int, w double")
    assert [r.s for r in normalize.min_max_scaled(w, "w", "s").collect()] == [0.0, 0.0, 0.0]
    masks = weights.extreme_masks(w, 0.5).orderBy("pixel").collect()
    assert [(r.pos_mask, r.neg_mask) for r in masks] == [(True, False), (True, False), (False, False)]
    with pytest.raises(ValueError):
        weights.extreme_masks(w, 1.0)


def test_bh_is_monotone_and_larger(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.5, 0.03])], "window int, p double")
    got = sorted((r.p, r.p_fdr) for r in significance.benjamini_hochberg(p).collect())
    assert [q for _, q in got] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5])


def test_rank_sum_of_an_empty_side(spark):
    a = spark.createDataFrame([(0, 0.5), (0, 0.7)], "window int, score double")
    assert significance.rank_sum(a, a.where("score > 9")).first().p == 1.0


@pytest.mark.parametrize(("n", "p"), [(60, 4), (40, 90), (80, 80)])
@pytest.mark.parametrize("c", [1e-4, 1.0, 100.0])
def test_svm_certificate(n, p, c):
    rng = np.random.default_rng(n + p)
    x = rng.standard_normal((n, p))
    y = (x[:, 0] + 0.5 * rng.standard_normal(n) > 0).astype(int)
    v = svm.fit(x, y, c)
    g = svm.gradient(v, np.c_[x, np.ones(n)], np.where(y > 0, 1.0, -1.0), c)
    assert np.abs(g).max() <= 1e-6 * max(1.0, c)


def samples(spark, n_trials=12, shift=3.0):
    rng = np.random.default_rng(3)
    rows = [(t, f, t % 2, (rng.standard_normal(3) + shift * (t % 2)).tolist()) for t in range(n_trials) for f in range(4)]
    return spark.createDataFrame(rows, "trial int, frame int, y int, features array<double>")


def test_decoding_finds_a_signal(spark):
    x = samples(spark)
    split = folds.modulo_folds(x, 3)
    assert metrics.fold_summary(metrics.fold_metrics(decoding.cross_validate(x, split, 0.1))).first().acc_trial_mean > 0.9
    got = decoding.nested_summary(decoding.nested(x, split, 2, (1e-3, 1e-1))).first()
    assert got.acc_mean > 0.85 and got.final_c in (1e-3, 1e-1)
    with pytest.raises(Exception, match="empty side|one training class"):
        decoding.cross_validate(x, x.select("trial").distinct().withColumn("fold", F.lit(0)), 0.1).collect()


def test_sliding_permutations(spark):
    x = samples(spark).withColumn("window", F.lit(0)).withColumn("center", F.lit(2))
    split = folds.modulo_folds(x, 3)
    labels = significance.permuted_labels(x.select("trial", "y").distinct(), 12)
    null = decoding.sliding_permutations(x, split, labels, 0.1)
    assert null.count() == 36
    got = decoding.sliding_significance(null, decoding.sliding_decode(x, split, 0.1), 0.2).first()
    assert got.real > 0.9 and 1 / 13 <= got.p <= 1


def test_permuted_labels_keep_counts(spark):
    t = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "trial int, y boolean")
    got = significance.permuted_labels(t, 5).groupBy("perm").agg(F.sum(F.col("y_perm").cast("int")).alias("k")).collect()
    assert {r.k for r in got} == {7}


@pytest.mark.parametrize("alternative", ["greater", "less", "two_sided"])
def test_exact_rank_sums_by_enumeration(spark, alternative):
    from itertools import combinations

    rng = np.random.default_rng(2)
    sizes = [(5, 7), (1, 4), (8, 9), (3, 12), (9, 9), (4, 0)]
    values = {w: (rng.permutation(a + b)[:a].tolist(), a, b) for w, (a, b) in enumerate(sizes)}
    real = [(w, float(x)) for w, (own, _, _) in values.items() for x in own]
    null = [(w, float(x)) for w, (own, a, b) in values.items() for x in range(a + b) if x not in own]
    got = {r.window: r for r in significance.rank_sum(*[spark.createDataFrame(rows, "window int, score double") for rows in (real, null)], alternative).collect()}
    for w, (own, a, b) in values.items():
        if min(a, b) > significance.EXACT:
            continue
        u = lambda chosen: sum(chosen) - len(chosen) * (len(chosen) - 1) // 2
        us = [u(c) for c in combinations(range(a + b), a)]
        above, below = (sum(side(x, u(own)) for x in us) / len(us) for side in ((lambda x, y: x >= y), (lambda x, y: x <= y)))
        want = {"greater": above, "less": below, "two_sided": min(1, 2 * min(above, below))}[alternative]
        assert got[w].u == u(own) and got[w].p == pytest.approx(want)
    assert 0 < got[4].p <= 1 and got[5].p == 1
    tied = significance.rank_sum(*[spark.createDataFrame([(0, x) for x in rows], "window int, score double") for rows in ([1.0, 2.0], [2.0, 3.0, 4.0])], alternative).first()
    assert 0 < tied.p <= 1


def test_step_up_adjustment_over_ranges(spark, monkeypatch):
    from trialframe.operators import ranking

    rng = np.random.default_rng(4)
    p = np.round(rng.random(90) ** 3, 2)
    keys = rng.integers(0, 2, 90)
    df = spark.createDataFrame([(int(k), i, float(x)) for i, (k, x) in enumerate(zip(keys, p, strict=True))] + [(0, 99, None), (None, 100, 0.03)], "k int, i int, p double")
    want = {}
    for k in (0, 1):
        mine = np.flatnonzero(keys == k)
        order = mine[np.argsort(p[mine], kind="stable")]
        q = p[order] * len(order) / np.arange(1, len(order) + 1)
        want |= dict(zip(order.tolist(), np.minimum(1, np.minimum.accumulate(q[::-1])[::-1]), strict=True))
    for rows in (ranking.ROWS, 9):
        monkeypatch.setattr(ranking, "ROWS", rows)
        got = {r.i: r.p_fdr for r in significance.benjamini_hochberg(df, keys=("k",)).collect()}
        assert len(got) == 92 and got.pop(99) is None and got.pop(100) == 0.03
        assert got == pytest.approx(want)
        one = significance.benjamini_hochberg(df.where("k = 0").drop("k")).collect()
        assert {r.i: r.p_fdr for r in one if r.i < 90} == pytest.approx({i: q for i, q in want.items() if keys[i] == 0})


@pytest.mark.parametrize("rows", [100_000, 7])
def test_percentiles_by_range_counts(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "ROWS", rows)
    rng = np.random.default_rng(5)
    values = {"a": rng.standard_normal(301), "b": np.repeat([1.0, 2.0], [400, 3]), None: rng.integers(0, 5, 50).astype(float), "c": np.array([7.0])}
    table = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("empty", None)], "k string, v double")
    got = {r.k: r for r in ranking.percentiles(table, "v", {"low": 0.03, "high": F.when(F.col("k") == "b", 1.0).otherwise(0.8)}, ("k",)).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        assert got[k].low == pytest.approx(np.percentile(x, 3), abs=1e-12)
        assert got[k].high == pytest.approx(np.percentile(x, 100 if k == "b" else 80), abs=1e-12)
    assert ranking.percentiles(table, "v", {"mid": 0.5}).first().mid == pytest.approx(np.median(np.concatenate(list(values.values()))))
    assert ranking.percentiles(table.where("v > 99"), "v", {"mid": 0.5}).first().mid is None


def test_masks_have_no_buffer_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 50)
    rng = np.random.default_rng(6)
    w = rng.standard_normal(400)
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)] + [(900, float("nan")), (901, float("inf")), (902, None)], "pixel int, w double")
    masks = weights.extreme_masks(table, 0.1)
    assert "percentile(" not in masks._jdf.queryExecution().toString()
    rows = {r.pixel: r for r in masks.collect()}
    high, low = np.percentile(w[w > 0], 90), np.percentile(w[w < 0], 10)
    assert {p for p, r in rows.items() if r.pos_mask} == set(np.flatnonzero(w >= high)) and {p for p, r in rows.items() if r.neg_mask} == set(np.flatnonzero(w <= low))
    assert len(rows) == 403 and weights.clip_limits(table, 75).first().high == pytest.approx(np.percentile(np.abs(w), 75))


@pytest.mark.parametrize("step", [1, 2])
def test_window_means_equal_means_over_copied_cells(spark, step):
    rng = np.random.default_rng(7)
    rows = [(f % 2, f, p, None if rng.random() < 0.1 else float("nan") if f == 9 and p == 0 else float(rng.standard_normal() + 1e6)) for f in range(20) for p in range(6)]
    cube = spark.createDataFrame(rows, "y int, frame int, pixel int, value double")
    first, last = features.window_starts(20, 4, 1, 20, step)
    means = lambda **k: {(r.window, r.center, r.y): r["mean"] for r in features.window_means(cube, "value", 4, first, last, step, ("y",), **k).collect()}
    copied = features.sliding_windows(cube, 4, first, last, step).groupBy("window", "center", "y")
    for got, x in ((means(), F.col("value")), (means(leave_out_nan=True), F.when(~F.isnan("value"), F.col("value")))):
        want = {(r.window, r.center, r.y): r["mean"] for r in copied.agg(F.avg(x).alias("mean")).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True) for k in want)
    assert any(np.isnan(v) for v in means().values()) and not any(np.isnan(v) for v in means(leave_out_nan=True).values())


def test_greedy_plan_of_one_giant_trial_is_short():
    plan = folds._greedy_plan([(10**12, 1), (1, 10**9)], 3)
    assert plan[1] == (1, [(0, [1, 2])])
    rng = np.random.default_rng(8)
    for _ in range(60):
        n_splits = int(rng.integers(2, 6))
        sizes = sorted((int(x) for x in rng.choice([0, 1, 2, 3, 7, 20, 50], int(rng.integers(1, 60)))), reverse=True)
        load, want = [0] * n_splits, []
        for x in sizes:
            want.append(load.index(min(load)))
            load[want[-1]] += x
        got = []
        for size, phases in folds._greedy_plan([(x, sizes.count(x)) for x in set(sizes)], n_splits):
            assert len(phases) <= n_splits
            for rank in range(sizes.count(size)):
                first, cycle = [p for p in phases if p[0] <= rank][-1]
                got.append(cycle[(rank - first) % len(cycle)])
        assert got == want


def test_step_up_sql_gives_equal_p_values_equal_results():
    rng = np.random.default_rng(9)
    for _ in range(20):
        p = rng.integers(1, 8, 12) / 8
        at = np.argsort(p, kind="stable")
        want = np.empty(12)
        want[at] = np.minimum(1, np.minimum.accumulate((p[at] * 12 / np.arange(1, 13))[::-1])[::-1])
        con = duckdb.connect()
        con.execute("CREATE TABLE t AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(p)) + ") AS v(i, p)")
        got = dict(con.execute(f"SELECT i, p_fdr FROM ({statistics._BH.format('t')})").fetchall())
        assert [got[i] for i in range(12)] == pytest.approx(list(want))
