"""Decoding: sums over distributed samples against fits of whole groups, plain versions of folds and ranks, all registered fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import svm
from trialframe.functions.estimators import Ridge
from trialframe.operators import decoding, folds, held, metrics, primal, ranking, significance
from trialframe.plans import preprocessing, statistics

SF = "/root/testdata/sf0.001"


def samples(spark, windows=1, n_trials=14):
    rng = np.random.default_rng(4)
    rows = [(w, w + 2, t, f, t % 2, (rng.standard_normal(3) + 0.8 * (t % 2)).tolist()) for w in range(windows) for t in range(n_trials) for f in range(3)]
    return spark.createDataFrame(rows, "window int, center int, trial int, frame int, y int, features array<double>")


def both(monkeypatch, run):
    """Rows of an experiment held as features, held as Gram blocks, and summed where the samples are."""
    out = [run().collect()]
    monkeypatch.setattr(held, "LOCAL", 0)
    out.append(run().collect())
    monkeypatch.setattr(held, "LABELS", 0)
    return *out, run().collect()


def same(one, two, three, keys):
    one, *others = ({tuple(r[k] for k in keys): r.asDict() for r in rows} for rows in (one, two, three))
    assert one
    for other in others:
        assert one.keys() == other.keys()
        for k, r in one.items():
            for c, v in r.items():
                assert v == (pytest.approx(other[k][c], abs=1e-6) if isinstance(v, float) else other[k][c]), (k, c)


def test_cross_validation_both_ways(spark, monkeypatch):
    x = samples(spark)
    split = folds.modulo_folds(x, 3)
    same(*both(monkeypatch, lambda: decoding.cross_validate(x.drop("window", "center"), split, 0.1)), ("trial", "frame"))


def test_weights_and_final_model_both_ways(spark, monkeypatch):
    x = samples(spark)
    split = folds.modulo_folds(x, 3)
    same(*both(monkeypatch, lambda: decoding.fold_weights(x, split, 0.1)), ("fold", "feature"))
    monkeypatch.undo()
    one, two, three = both(monkeypatch, lambda: decoding.final_model(x, 0.1).select("feature", "w"))
    same(one, two, three, ("feature",))
    monkeypatch.undo()
    data = x.orderBy("trial", "frame").collect()
    v = svm.fit(np.array([r.features for r in data]), np.array([r.y for r in data]), 0.1)
    assert sorted(r.w for r in one) == pytest.approx(sorted(v), abs=1e-7)
    assert decoding.final_model(x, 0.1).agg(F.max(F.abs("gradient"))).first()[0] < 1e-6


@pytest.mark.parametrize("metric", ["acc", "auc"])
def test_nested_both_ways(spark, monkeypatch, metric):
    x = samples(spark)
    split = folds.modulo_folds(x, 3)
    keys = ("outer", "c", "fold")
    same(*both(monkeypatch, lambda: decoding.inner_scores(x, split, 2, (1e-3, 1e-1), metric).select(*keys, "metric")), keys)
    monkeypatch.undo()
    same(*both(monkeypatch, lambda: decoding.nested(x, split, 2, (1e-3, 1e-1), metric)), ("trial", "frame"))


def test_nested_record(spark):
    x = samples(spark)
    split = folds.modulo_folds(x, 3)
    got = decoding.nested_record(x, split, 2, (1e-2, 1e-1))
    assert got["trials"].count() == 14 and got["weights"].count() == 3 * 4 and got["folds"].count() == 3
    assert sum(r.n for r in got["confusion"].collect()) == 14
    one_class = spark.createDataFrame([(t, t % 2 + 2 * (t % 3)) for t in range(14)], "trial int, fold int")
    assert decoding.nested_record(x, one_class, 2, (1e-2,))["weights"].count() == 6 * 4


@pytest.mark.parametrize("folds_of", [[(t, 0 if t < 7 else 1) for t in range(13)], [(t % 14, t % 2) for t in range(15)]])
def test_folds_that_do_not_cover(spark, folds_of):
    split = spark.createDataFrame(folds_of, "trial int, fold int")
    for run in (lambda: decoding.cross_validate(samples(spark), split, 0.1), lambda: decoding.nested_record(samples(spark), split, 2, (0.1,))):
        with pytest.raises(RuntimeError, match="exactly once"):
            run()


def test_sliding_both_ways(spark, monkeypatch):
    x = samples(spark, 2)
    split = folds.modulo_folds(x, 3)
    same(*both(monkeypatch, lambda: decoding.sliding_decode(x, split, 0.1)), ("window", "trial", "frame"))
    monkeypatch.undo()
    same(*both(monkeypatch, lambda: decoding.sliding_weights(x, split, 0.1)), ("window", "fold", "feature"))
    monkeypatch.undo()
    record = decoding.sliding_record(x, split, 0.1)
    assert record["weights"].count() == 2 * 3 and record["curve"].count() == 2


def test_permutations_both_ways(spark, monkeypatch):
    x = samples(spark, 2)
    split = folds.modulo_folds(x, 3)
    labels = significance.permuted_labels(x.select("trial", "y").distinct(), 5).withColumn("perm", F.col("perm") + 3)
    same(*both(monkeypatch, lambda: decoding.sliding_permutations(x, split, labels, 0.1)), ("perm", "window", "fold"))
    monkeypatch.undo()
    one = x.where("window = 0")
    for metric in ("acc", "auc"):
        same(*both(monkeypatch, lambda metric=metric: decoding.fixed_permutations(one, split, labels, 2, (1e-3, 1e-1), metric)), ("perm", "fold"))
        monkeypatch.undo()


def slow_greedy(sizes, k):
    load, out = [0] * k, {}
    for t, n in sorted(sizes, key=lambda r: (-r[1], r[0])):
        f = load.index(min(load))
        load[f] += n
        out[t] = f
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_greedy_folds_against_a_loop(spark, k):
    rng = np.random.default_rng(k)
    for sizes in ([(1, 10), (2, 1), (3, 1), (4, 7), (5, 4)], [(i, int(n)) for i, n in enumerate(rng.integers(0, 6, 60))], [(i, 4) for i in range(23)]):
        got = folds.greedy_folds(spark.createDataFrame(sizes, "trial int, n int"), k)
        assert {r.trial: r.fold for r in got.collect()} == slow_greedy(sizes, k)


def test_running_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 7)
    rng = np.random.default_rng(0)
    rows = [(int(k), float(x), int(n)) for k, x, n in zip(rng.integers(0, 2, 60), rng.permutation(60), rng.integers(0, 9, 60), strict=True)]
    df = spark.createDataFrame(rows, "k int, x double, n int")
    got = ranking.running_sums(df, "x", {"before": F.col("n")}, ("k",)).collect()
    assert len(got) == 60
    assert all(r.before == sum(n for k, x, n in rows if k == r.k and x < r.x) for r in got)
    assert sorted(r.at for r in ranking.ranked(df, "x", "at").collect()) == list(range(60))


def test_ranges_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, 0, i % 4, int(rng.integers(0, 2)), 0, float(np.round(rng.standard_normal(), 1))) for i in range(90)]
    p = spark.createDataFrame(rows, "trial int, frame int, fold int, y_true int, y_pred int, score double")
    run = lambda: (
        metrics.roc_auc(p).first().auc, metrics.curve_area(metrics.roc_curve(p)).first().auc, sorted(tuple(r) for r in metrics.roc_auc(p, ("fold",)).collect()),
        sorted(tuple(r) for r in folds.modulo_folds(p, 7).collect()), sorted(tuple(r) for r in significance.permuted_labels(p.selectExpr("trial", "y_true y"), 3).collect()),
    )
    one = run()
    monkeypatch.setattr(ranking, "ROWS", 11)
    monkeypatch.setattr(significance, "ROWS", 11)
    two = run()
    assert one[3:] == two[3:] and one[:2] == pytest.approx(two[:2]) and one[0] == pytest.approx(one[1])
    assert [a for r in one[2] for a in r] == pytest.approx([a for r in two[2] for a in r])


@pytest.mark.parametrize("name", [*statistics.ROWS_ONLY, "fold_assign_greedy"])
def test_registered_without_sql(spark, name):
    rows = (preprocessing.QUERIES | statistics.QUERIES)[name](spark, SF).collect()
    assert rows
    for r in rows:
        for c, v in r.asDict().items():
            assert v is None or not isinstance(v, float) or np.isfinite(v)
            if "acc" in c and "std" not in c and v is not None:
                assert 0 <= v <= 1


def test_wide_sliding_windows_share_frame_pairs(spark, monkeypatch):
    """Images of 40 pixels in 4 windows: Gram blocks in slices of 7 pixels against fits of the images themselves."""
    rng = np.random.default_rng(8)
    cells = [(t, t % 2, f, p, float(rng.normal() + 0.3 * (t % 2) * (p < 5))) for t in range(9) for f in range(7) for p in range(40)]
    cube = spark.createDataFrame(cells, "trial int, y int, frame int, pixel int, value double")
    x = decoding.window_samples(cube, 3, 0, 4, 1).where("window <> 2")
    split = folds.modulo_folds(cube.select("trial").distinct(), 3)
    computed = []
    pairs_of = held.frame_pairs
    monkeypatch.setattr(held, "SLICE", 7 * 9 * 7)
    monkeypatch.setattr(held, "frame_pairs", lambda slices, trials, pairs: computed.append((pairs, slices.select("first").distinct().count())) or pairs_of(slices, trials, pairs))
    got = decoding.sliding_record(x, split, 0.02)
    assert computed == [([(f, g) for f in range(7) for g in range(f, 7) if g - f < 3 and (f, g) != (2, 4)], 6)]
    value = {(t, f, p): v for t, _, f, p, v in cells}
    features = np.array([[[value[t, f, p] for p in range(40)] for f in range(7)] for t in range(9)])
    scores, weights = {}, {}
    for w in (0, 1, 3, 4):
        for k in range(3):
            on = [(t, f) for t in range(9) if t % 3 != k for f in range(w, w + 3)]
            v = svm.fit_primal(np.array([features[t, f] for t, f in on]), np.array([t % 2 for t, _ in on]), 0.02)
            weights.setdefault(w, []).append(v[:-1])
            scores |= {(w, t, f): features[t, f] @ v[:-1] + v[-1] for t in range(9) if t % 3 == k for f in range(w, w + 3)}
    found = {(r.window, r.trial, r.frame): r.score for r in got["predictions"].collect()}
    assert found.keys() == scores.keys() and all(found[k] == pytest.approx(v, abs=1e-6) for k, v in scores.items())
    for r in got["weights"].collect():
        assert r["mean"] == pytest.approx(np.mean([v[r.feature] for v in weights[r.window]]), abs=1e-7)
        assert r["std"] == pytest.approx(np.std([v[r.feature] for v in weights[r.window]], ddof=1), abs=1e-7)


def test_a_second_estimator_all_ways(spark, monkeypatch):
    x = samples(spark)
    split = folds.modulo_folds(x, 3)
    same(*both(monkeypatch, lambda: decoding.cross_validate(x.drop("window", "center"), split, 0.1, Ridge())), ("trial", "frame"))


def embeddings(spark):
    return {r.vec_id: (np.array(r.embedding, float), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def movies(spark):
    """Trials, features (frames 2 to 5 of all pixels) and classes, of the registered wide queries."""
    e = embeddings(spark)
    trials = sorted({v // 8 for v in e if all(v // 8 * 8 + f in e for f in range(2, 6))})
    y = [sum(e[v][1] for v in range(8 * t, 8 * t + 8) if v in e) % 2 for t in trials]
    return np.array(trials), np.array([np.concatenate([e[8 * t + f][0] for f in range(2, 6)]) for t in trials]), np.array(y)


def test_wide_queries_against_loops(spark):
    trials, x, y = movies(spark)
    assert x.shape[1] > len(x)
    fold, scores = np.arange(len(trials)) % 5, {}
    for k in range(5):
        v = svm.fit_primal(x[fold != k], y[fold != k], 0.01)
        scores |= dict(zip(trials[fold == k].tolist(), svm.decide(x[fold == k], v), strict=True))
    got = {r.trial: r.score for r in statistics.QUERIES["svm_wide_window"](spark, SF).collect()}
    assert got.keys() == scores.keys() and all(got[t] == pytest.approx(s, abs=1e-6) for t, s in scores.items())
    v = svm.fit_primal(x, y, 0.01)
    rows = statistics.QUERIES["svm_wide_weights"](spark, SF).collect()
    assert {r.feature: r.w for r in rows} == pytest.approx(dict(zip([*range(256), -1], v, strict=True)), abs=1e-7)
    assert max(abs(r.gradient) for r in rows) < 1e-6


def plain_nested(x, y, trials, fold, inner_splits=4):
    """Chosen C and accuracy per outer fold by nested loops."""
    out = []
    for k in range(5):
        train = fold != k
        names = np.unique(trials[train])
        inner, by_c = np.searchsorted(names, trials[train]) % inner_splits, {}
        for c in decoding.C_GRID:
            hits = []
            for j in range(inner_splits):
                v = svm.fit(x[train][inner != j], y[train][inner != j], c)
                hits.append(((svm.decide(x[train][inner == j], v) > 0) == y[train][inner == j]).mean())
            by_c[c] = (np.mean(hits), np.std(hits, ddof=1) / 2)
        best = max(by_c, key=lambda c: (round(by_c[c][0], 12), -c))
        c = min(c for c in by_c if round(by_c[c][0], 12) >= round(by_c[best][0] - by_c[best][1], 12))
        v = svm.fit(x[train], y[train], c)
        out.append((c, ((svm.decide(x[~train], v) > 0) == y[~train]).mean()))
    return out


def test_nested_queries_against_loops(spark):
    trials, x, y = movies(spark)
    want = plain_nested(x, y, trials, np.arange(len(trials)) % 5)
    got = statistics.QUERIES["svm_wide_nested"](spark, SF).first()
    assert got.acc_mean == pytest.approx(np.mean([a for _, a in want])) and got.acc_std == pytest.approx(np.std([a for _, a in want], ddof=1))
    e = embeddings(spark)
    ids = sorted(e)
    x = np.array([[e[t][0][4 * f + p] for p in (0, 1, 3)] for t in ids for f in range(4, 9)])
    y, trial = np.repeat([e[t][1] % 2 for t in ids], 5), np.repeat(ids, 5)
    want = plain_nested(x, y, trial, np.repeat(np.arange(len(ids)) % 5, 5))
    got = statistics.QUERIES["svm_nested_cv"](spark, SF).first()
    assert got.acc_mean == pytest.approx(np.mean([a for _, a in want]))
    fold, scores = trial // 100 % 5, {}
    for k in range(5):
        v = Ridge().fit(x[fold != k], y[fold != k], 0.1)
        scores |= {(int(t), f): s for t, f, s in zip(trial[fold == k], np.tile(range(4, 9), len(ids))[fold == k], svm.decide(x[fold == k], v), strict=True)}
    rows = statistics.QUERIES["ridge_in_blocks"](spark, SF).collect()
    at = min(r.frame for r in rows) - 4
    assert len(rows) == len(scores) and all(r.score == pytest.approx(scores[r.trial, r.frame - at], abs=1e-8) for r in rows)


@pytest.mark.parametrize(
    "splitter", [[], lambda t: t.select("trial", F.lit(0).alias("fold")), lambda t: t.select((F.col("trial") + 90).alias("trial"), F.lit(0).alias("fold")), [({0, 1}, {2, 3}), ({0, 1}, {2})], [({0, 1, 2}, {2, 3})]]
)
def test_bad_splitters(spark, splitter):
    with pytest.raises(ValueError):
        folds.splits(spark.range(4).withColumnRenamed("id", "trial"), splitter)


def test_splitters(spark):
    trials = spark.range(4).withColumnRenamed("id", "trial")
    pairs = [({0, 1}, {2, 3}), ({2, 3}, {0, 1})]
    for splitter in (pairs, lambda t: t.select("trial", (F.col("trial") < 2).cast("int").alias("fold"))):
        assert {r.trial: r.fold for r in folds.splits(trials, splitter).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_distributed_fits_share_their_rounds(spark, monkeypatch):
    """63 inner fits of 257 numbers each go through the samples together, not one after the other."""
    rng = np.random.default_rng(3)
    rows = [(t, 0, t % 2, (rng.standard_normal(256) + 0.3 * (t % 2)).tolist()) for t in range(30)]
    x = spark.createDataFrame(rows, "trial int, frame int, y int, features array<double>")
    split = spark.createDataFrame([(t, t // 2 % 3) for t in range(30)], "trial int, fold int")
    want = {(r.outer, r.c, r.fold): r.metric for r in decoding.inner_scores(x, split, 3).collect()}
    monkeypatch.setattr(held, "LABELS", 0)
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        got = {(r.outer, r.c, r.fold): r.metric for r in decoding.inner_scores(x, split, 3).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == pytest.approx(want) and len(got) == 63
    assert jobs < 150


def test_sums_of_a_scan_do_not_grow_with_its_partitions(spark):
    counted = primal.totals(spark.range(0, 1000, 1, 60), lambda batches: [(7, np.array([1.0, sum(b.num_rows for b in batches)]))])
    assert counted.keys() == {7} and counted[7][1] == 1000 and counted[7][0] <= max(primal.PARTS, spark.sparkContext.defaultParallelism)


def test_shuffled_bytes_of_a_fit_do_not_grow_with_the_partitions_of_its_samples(spark):
    rng = np.random.default_rng(5)
    rows = [(t, t % 2, (rng.standard_normal(80) + 0.2 * (t % 2)).tolist()) for t in range(192)]
    x = spark.createDataFrame(rows, "trial int, y int, features array<double>")
    core = spark.sparkContext._jsc.sc()

    def shuffled():
        core.listenerBus().waitUntilEmpty()
        return core.statusStore().executorSummary("driver").totalShuffleWrite()

    def fit(parts):
        placed = x.repartition(parts, "trial").persist()
        placed.count()
        before = shuffled()
        v, _ = primal.fit_tasks(placed, [{"c": 0.1}], lambda known, _: (known["trial"] % 5 > 0, known["y"]), [0.1])
        placed.unpersist()
        return shuffled() - before, v[0]

    (few, v), (many, w) = fit(8), fit(64)
    on = [r for r in rows if r[0] % 5]
    assert v == pytest.approx(svm.fit_primal(np.array([r[2] for r in on]), np.array([r[1] for r in on]), 0.1), abs=1e-7) and w == pytest.approx(v, abs=1e-7)
    assert 0 < many < 1.5 * few


def test_permuted_accuracies_are_counted_where_the_samples_are(spark, monkeypatch):
    """Without predictions of all permutations, and with trials that go over several batches."""
    x = samples(spark, 2)
    split = folds.modulo_folds(x, 3)
    labels = significance.permuted_labels(x.select("trial", "y").distinct(), 3)
    rows = lambda: {(r.perm, r.window, r.fold): (r.frame_acc, r.trial_acc) for r in decoding.sliding_permutations(x, split, labels, 0.1).collect()}
    want = rows()
    monkeypatch.setattr(held, "LABELS", 0)
    monkeypatch.setattr(decoding, "_predicted", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = rows()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) == 18
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_held_samples_have_only_the_columns_of_fits(spark, monkeypatch):
    x = samples(spark).withColumn("sample_id", F.lit(7))
    labels = significance.permuted_labels(x.select("trial", "y").distinct(), 3)
    seen = []
    check = decoding._check_held
    monkeypatch.setattr(decoding, "_check_held", lambda keys: seen.append(keys) or check(keys))
    decoding.fixed_permutations(x.drop("window", "center"), folds.modulo_folds(x, 3), labels, 2, (0.1,))
    assert seen[0].keys() == {"trial", "frame", "y", "fold", "ys", "inner"}
    assert seen[0]["ys"].dtype == seen[0]["inner"].dtype == np.int8


def test_held_samples_count_with_their_keys_and_labels(spark, monkeypatch):
    """Two features a sample are fewer numbers than its keys and labels: together they bound what each worker holds."""
    rows = [(t, f, t % 2, [float(t), float(f)], t % 3, [t % 2] * 16) for t in range(12) for f in range(3)]
    x = spark.createDataFrame(rows, "trial int, frame int, y int, features array<double>, fold int, ys array<tinyint>")
    monkeypatch.setattr(held, "GRAM", 0)
    monkeypatch.setattr(held, "LOCAL", 36 * 2)
    assert held.hold(x) is None and held.hold(x.drop("ys")) is None
    monkeypatch.setattr(held, "LOCAL", int(36 * (2 + 5 / 2 + 16 / 8)))
    assert held.hold(x).x.shape == (36, 2)
    monkeypatch.setattr(held, "LOCAL", held.LOCAL - 1)
    assert held.hold(x) is None and held.hold(x.drop("ys")) is not None
