"""Rules checked while rows pass."""

import pytest
from pyspark.sql import functions as F

from trialframe.operators import metrics, significance, validation
from trialframe.sources import runs

PREDICTIONS = "trial int, frame int, fold int, y_true int, y_pred int, score double"


def predictions(spark, rows):
    return spark.createDataFrame(rows, PREDICTIONS)


def good(spark):
    return predictions(spark, [(t, f, t % 2, t % 2, 1, t - 1.5) for t in range(4) for f in range(2)])


def test_observed_rules(spark):
    rows, verify = validation.observed(good(spark), validation.prediction_rules(), {"class 0 is there": F.col("y_true") == 0})
    assert rows.count() == 8
    verify()
    bad = predictions(spark, [(0, 0, None, 1, 1, 0.5), (0, 1, 0, 2, 1, float("nan")), (1, 0, 0, 1, None, None)])
    rows, verify = validation.observed(bad, validation.prediction_rules(), {"class 0 is there": F.col("y_true") == 0})
    assert len(rows.collect()) == 3  # nothing is lost by looking
    with pytest.raises(ValueError, match="tested: not so in 1 rows; labels.*2 rows; scores.*2 rows; class 0 is there: in no row"):
        verify()
    rows, verify = validation.observed(bad, {})
    verify()  # no rules, nothing to wait for


def test_cube_rules(spark):
    cells = [(0, 0, 0, 1.0), (0, 1, 2, float("nan")), (0, 2, 0, None), (-1, 0, 0, 1.0), (0, 0, None, 1.0), (0, 0, 1, float("-inf"))]
    rows, verify = validation.observed(spark.createDataFrame(cells, "trial int, frame int, pixel int, value double"), validation.cube_rules(2, 2))
    rows.collect()
    with pytest.raises(ValueError, match="from 0: not so in 2 rows; values.*1 rows; frames are below 2: not so in 1 rows; pixels are below 2: not so in 2 rows"):
        verify()


def test_a_run_that_breaks_a_rule_has_no_manifest(spark, tmp_path):
    runs.save_run({"p": good(spark)}, {}, str(tmp_path), "good", rules={"p": validation.prediction_rules()})
    with pytest.raises(ValueError, match="labels are 0 or 1"):
        runs.save_run({"p": good(spark).withColumn("y_pred", F.lit(3))}, {}, str(tmp_path), "bad", rules={"p": validation.prediction_rules()})
    with pytest.raises(ValueError, match="not there"):
        runs.save_run({"p": good(spark)}, {}, str(tmp_path), "other", rules={"q": {}})
    assert [r.run_id for r in runs.list_runs(spark, str(tmp_path)).collect()] == ["good"]


def test_real_and_null_windows_match(spark):
    null = spark.createDataFrame([(p, w, 0.4 + 0.01 * p) for p in range(9) for w in range(3)], "perm int, window int, score double")
    real = spark.createDataFrame([(w, 0.9) for w in range(3)], "window int, score double")
    strict = lambda n, r: significance.window_significance(n, r, strict=True)
    got = {r.window: (r.p, r.n_nan) for r in strict(null, real).collect()}
    assert got == {r.window: (r.p, 0) for r in significance.window_significance(null, real).collect()}
    nan = null.withColumn("score", F.when(F.col("perm") == 2, float("nan")).otherwise(F.col("score")))
    assert {r.n_nan for r in strict(nan, real).collect()} == {1}
    twice = real.union(spark.createDataFrame([(1, 0.5)], real.schema))
    for n, r in ((null.where("window < 2"), real), (null, real.where("window > 0")), (null.where("window < 2 or perm < 5"), real), (null, twice)):
        with pytest.raises(Exception, match="do not match"):
            strict(n, r).collect()
        significance.window_significance(n, r).collect()


def test_metrics_fail_on_what_they_cannot_show(spark):
    table = good(spark)
    one = table.where("y_true = 1")
    assert sorted(metrics.roc_curve(table, strict=True).collect(), key=str) == sorted(metrics.roc_curve(table).collect(), key=str)
    assert metrics.roc_curve(one).count() > 1
    with pytest.raises(Exception, match="both classes"):
        metrics.roc_curve(one, strict=True).collect()
    samples = table.select("trial", "frame", "y_true")
    assert sorted(metrics.out_of_fold(samples, table, strict=True).collect()) == sorted(metrics.out_of_fold(samples, table).collect())
    for s, p in ((samples, table.where("trial > 0")), (samples.where("trial > 0"), table)):
        with pytest.raises(Exception, match="not aligned"):
            metrics.out_of_fold(s, p, strict=True).collect()
    none = table.withColumn("score", F.lit(float("nan")))
    assert metrics.histogram(none, "score", 3).count() == 3
    with pytest.raises(Exception, match="no value is finite"):
        metrics.histogram(none, "score", 3, strict=True).collect()
    with pytest.raises(ValueError, match="one bin"):
        metrics.histogram(table, "score", 0)
