"""Registered queries: metrics, model choice, permutation statistics, weight maps, decoding, run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.estimators import Ridge
from ..functions.numeric import normal_tail_sql
from ..operators import decoding, features, folds, metrics, significance, weights
from ..sources import fixtures as fx
from ..sources import runs
from .preprocessing import _r


def majority_vote(s, d):
    return metrics.majority_vote(fx.predictions(s, d))


def frame_accuracy(s, d):
    return _r(metrics.accuracy(fx.predictions(s, d)), acc=6)


def trial_accuracy(s, d):
    return _r(metrics.trial_accuracy(fx.predictions(s, d)), acc=6)


def fold_metrics(s, d):
    return _r(metrics.fold_metrics(fx.predictions(s, d)), acc=6, auc=6, acc_trial=6)


def fold_summary(s, d):
    out = metrics.fold_summary(metrics.fold_metrics(fx.predictions(s, d)))
    return _r(out, **dict.fromkeys(out.columns, 6))


def confusion_counts(s, d):
    return metrics.confusion(fx.predictions(s, d))


def confusion_normalized(s, d):
    from ..operators.normalize import row_normalised

    return _r(row_normalised(metrics.confusion(fx.predictions(s, d))), share=6)


def out_of_fold(s, d):
    p = fx.predictions(s, d)
    return _r(metrics.out_of_fold(p.select("trial", "frame", "y_true"), p.where("fold < 8")), score=6)


def roc_auc(s, d):
    return _r(metrics.roc_auc(fx.predictions(s, d)), auc=6)


def roc_auc_by_fold(s, d):
    return _r(metrics.roc_auc(fx.predictions(s, d), ("fold",)), auc=6)


def roc_curve(s, d):
    return _r(metrics.roc_curve(fx.predictions(s, d)), threshold=6, fpr=6, tpr=6)


def roc_curve_area(s, d):
    return _r(metrics.curve_area(metrics.roc_curve(fx.predictions(s, d))), auc=6)


def sem_by_fold(s, d):
    return _r(metrics.sem(fx.predictions(s, d), "score", ("fold",)), sem=6)


def metric_histogram(s, d):
    return _r(metrics.histogram(fx.window_scores(s, d)[0], "score", 30), low=6, high=6)


def _window_curve(s, d):
    return metrics.accuracy(fx.predictions(s, d), ("frame",)).select((F.col("frame") + 3).alias("center"), "acc")


def peak_window(s, d):
    return _r(metrics.peak(_window_curve(s, d)), peak=6)


def select_c_one_se(s, d):
    return _r(metrics.select_c(fx.c_grid(s, d)), c=6)


def select_c_best(s, d):
    return _r(metrics.select_c(fx.c_grid(s, d), "best", "larger"), c=6)


def _choices(s, d):
    """The best C of each fold of the grid, larger ones first."""
    return fx.c_grid(s, d).groupBy("fold").agg(F.max_by("c", F.struct("metric", "c")).alias("c"))


def final_c_mode_median(s, d):
    return _r(metrics.final_c(_choices(s, d)), c=6)


def final_c_median(s, d):
    return _r(metrics.final_c(_choices(s, d), "median"), c=6)


def permute_labels(s, d):
    return significance.permuted_labels(fx.trials(s, d), 20)


def perm_null_scores(s, d):
    return _r(fx.window_scores(s, d)[0], score=6)


def _fixed(s, d):
    null, real = fx.window_scores(s, d)
    out = significance.fixed_significance(null.groupBy("perm").agg(F.avg("score").alias("score")), real.agg(F.avg("score").alias("score")))
    return out.withColumn("text", significance.p_text(F.col("p_one_tailed"), F.col("n")))


def perm_pvalue_one_tailed(s, d):
    return _r(_fixed(s, d).select("real", "p_one_tailed", "null_mean", "null_std", "pass_one_tailed", "text"), real=6, p_one_tailed=6, null_mean=6, null_std=6)


def perm_pvalue_two_tailed(s, d):
    return _r(_fixed(s, d).select("p_two_tailed", "null_min", "null_max", "pass_two_tailed"), p_two_tailed=6, null_min=6, null_max=6)


def window_perm_pvalues(s, d):
    return _r(significance.window_significance(*fx.window_scores(s, d), alpha=0.05), real=6, p=6, p_fdr=6)


def bh_fdr(s, d):
    p = fx.weights(s, d).groupBy("pixel").agg(F.abs(F.avg("w")).alias("p"))
    return _r(significance.benjamini_hochberg(p), p=6, p_fdr=6)


def _folds_as_windows(s, d):
    by = metrics.accuracy(fx.predictions(s, d), ("frame", "fold")).select(F.col("frame").alias("window"), F.col("acc").alias("score"))
    return by, fx.window_scores(s, d)[0].select("window", "score")


def ranksum_by_window(s, d):
    return _r(significance.rank_sum(*_folds_as_windows(s, d)), z=5, p=5)


def _small_samples(s, d):
    """Sixteen trials in turn are a window: six values against ten."""
    p = fx.predictions(s, d).where("frame = 0").select(F.expr("cast(trial div 16 as int)").alias("window"), "trial", "score")
    return p.where("trial % 16 < 6").drop("trial"), p.where("trial % 16 >= 6").drop("trial")


def ranksum_exact(s, d):
    return _r(significance.rank_sum(*_small_samples(s, d)).drop("z"), p=8)


def ranksum_exact_two_sided(s, d):
    return _r(significance.rank_sum(*_small_samples(s, d), "two_sided").drop("z"), p=8)


def ranksum_two_sided(s, d):
    return _r(significance.rank_sum(*_folds_as_windows(s, d), "two_sided"), z=5, p=5)


def ranksum_adjusted(s, d):
    return _r(significance.rank_sum_adjusted(*_folds_as_windows(s, d)), z=5, p=5, p_fdr=5)


def significance_head(s, d):
    return _r(significance.first_windows(significance.window_significance(*fx.window_scores(s, d), alpha=0.05), 5), real=6, p=6, p_fdr=6)


def run_time_suffix(s, d):
    days = fx.table(s, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("t")).distinct()
    names = days.select(runs.suffixed(F.lit("sliding__tag"), F.col("t")).alias("name"))
    return names.select("name", F.date_format(runs.run_time(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def perm_summary_schema(s, d):
    """Summaries of each permutation's scores, half of them under the older names."""
    null = fx.window_scores(s, d)[0].groupBy("perm").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.max("score").alias("hi"))
    names = {"m": ("shuffled_trial_mean", "shuffled_mean"), "sd": ("shuffled_trial_std", "shuffled_std"), "hi": ("shuffled_trial_max", "shuffled_max")}
    new, old = (null.where(f"perm {side} 10").select(F.col("perm").cast("string").alias("run_id"), *[F.col(c).alias(n[i]) for c, n in names.items()]) for i, side in enumerate(("<", ">=")))
    out = runs.unified_summary(new.unionByName(old, allowMissingColumns=True))
    return _r(out.select("run_id", *[n[0] for n in names.values()]), **{n[0]: 6 for n in names.values()})


def sliding_record_curves(s, d):
    """Record of a sliding permutation run and its curves, as read back."""
    null, real = fx.window_scores(s, d)
    folds_of = lambda t: t.withColumn("fold", F.lit(0)).withColumn("trial_acc", F.col("score")).withColumn("frame_acc", F.col("score"))
    centers = real.select("window", (F.col("window") + 2).alias("center"))
    record = runs.sliding_permutation_record(folds_of(null), centers, folds_of(real), folds_of(real)).withColumn("run_id", F.lit("r"))
    out = runs.sliding_curves(record).drop("run_id")
    return _r(out, **{c: 6 for c in out.columns if c not in ("window", "center")})


def sliding_record_null(s, d):
    """The null of such a record, cell by cell."""
    null, real = fx.window_scores(s, d)
    rows = null.withColumn("fold", F.lit(0)).withColumn("trial_acc", F.col("score")).withColumn("frame_acc", 1 - F.col("score"))
    record = runs.sliding_permutation_record(rows, real.select("window", (F.col("window") + 2).alias("center"))).withColumn("run_id", F.lit("r"))
    return _r(runs.sliding_null(record).drop("run_id"), trial_acc=6, frame_acc=6)


def fixed_record(s, d):
    """Record of a fixed permutation run: each window a fold, the real run without permutation."""
    null, real = fx.window_scores(s, d)
    null = null.select("perm", F.col("window").alias("fold"), F.col("score").alias("trial_acc"), (1 - F.col("score")).alias("frame_acc"))
    real = real.agg(F.avg("score").alias("acc_trial_mean"), F.stddev_samp("score").alias("acc_trial_std"), F.avg(1 - F.col("score")).alias("acc_mean"), F.stddev_samp("score").alias("acc_std"))
    out = runs.fixed_permutation_record(null, real).drop("shuffled_scores_trials", "shuffled_scores_frames")
    return _r(out, **{c: 6 for c in out.columns if c != "pass_alpha_0p05_trial"})


def null_band(s, d):
    return _r(significance.null_band(fx.window_scores(s, d)[0]), mean=6, low=6, high=6)


def weight_stats(s, d):
    return _r(weights.weight_stats(fx.weights(s, d), ("window",)), mean=6, std=6, abs_mean=6, scaled=6)


def weight_image(s, d):
    image = fx.weights(s, d).select("pixel").distinct()
    return _r(weights.weight_image(features.in_region(weights.weight_stats(fx.weights(s, d)), fx.roi(s)).withColumnRenamed("mean", "w"), image), w=6)


def weight_pixel_time(s, d):
    w = fx.weights(s, d).groupBy("window", "pixel").agg(F.avg("w").alias("w"))
    return _r(weights.pixel_time(features.in_region(w, fx.roi(s)), w.select("pixel").distinct()), w=6)


def extreme_masks(s, d):
    w = weights.weight_stats(fx.weights(s, d)).select("pixel", F.col("mean").alias("w"))
    return _r(weights.extreme_masks(w, 0.2), w=6, pos_cut=6, neg_cut=6)


def _mean_windows(s, d):
    return fx.weights(s, d).groupBy("window", "pixel").agg(F.avg("w").alias("w"))


def extreme_masks_sliding(s, d):
    return _r(weights.extreme_masks(_mean_windows(s, d), 0.2, ("window",)), w=6, pos_cut=6, neg_cut=6)


def extreme_masks_nonstrict(s, d):
    return _r(weights.extreme_masks(_mean_windows(s, d), 0.2, ("window",), strict=False), w=6, pos_cut=6, neg_cut=6)


def pos_neg_timecourse(s, d):
    masks = weights.extreme_masks(weights.weight_stats(fx.weights(s, d)).select("pixel", F.col("mean").alias("w")), 0.3)
    cube = _mean_windows(s, d).select("pixel", F.col("window").alias("frame"), F.col("w").alias("value"))
    return _r(weights.sign_timecourse(cube, masks), mean=6)


def clip_limits(s, d):
    return _r(weights.clip_limits(fx.weights(s, d)), low=6, high=6)


def clip_limits_percentile(s, d):
    return _r(weights.clip_limits(fx.weights(s, d), 90), low=6, high=6)


def movie_status(s, d):
    p = fx.predictions(s, d)
    voted = F.broadcast(metrics.trial_accuracy(p, ()).select(F.round("acc", 3).alias("trial_acc")))  # one row
    curve = metrics.accuracy(p, ("frame",)).select(F.col("frame").alias("window"), (F.col("frame") + 3).alias("center"), F.round("acc", 3).alias("frame_acc")).crossJoin(voted)
    return weights.movie_status(curve)


def _names(s, d):
    """Run names with a session token for odd parts, from lineitem."""
    key = F.concat_ws("", F.lit("sliding_window_"), F.lit("_"), F.col("l_partkey").cast("string"), F.lower("l_returnflag"), F.col("l_suppkey").cast("string"), F.lit("_frame1-100"))
    return fx.table(s, d, "lineitem").select(F.when(F.col("l_partkey") % 2 == 1, key).otherwise(F.lit("run without token")).alias("name")).distinct()


def run_name_parse(s, d):
    return runs.parse_run_names(_names(s, d))


def file_catalog(s, d):
    files = fx.sparse(s, d).select(F.format_string("/data/conds%d_%s.npy", "cond", F.lower("session")).alias("path")).distinct()
    return runs.file_catalog(files)


def perm_schema_coalesce(s, d):
    null, _ = fx.window_scores(s, d)
    new = null.where("perm < 10").groupBy("perm").agg(F.avg("score").alias("shuffled_scores_trials"), F.max("score").alias("shuffled_scores_frames"))
    old = null.where("perm >= 10").groupBy("perm").agg(F.avg("score").alias("shuffled_scores"))
    return _r(runs.unified_permutations(new.unionByName(old, allowMissingColumns=True)), trial_score=6, frame_score=6)


def _samples(s, d, start=4, end=9):
    """Samples of the region in a window, a quarter of the frames' noise kept as it is."""
    cube = features.in_region(fx.dense(s, d), fx.roi(s))
    return features.frames_as_samples(cube.where(f"frame >= {start} and frame < {end}"), start, end - start)


def svm_fixed_window(s, d):
    return metrics.fold_metrics(decoding.cross_validate(_samples(s, d), folds.modulo_folds(fx.trials(s, d), 5), 0.01))


def svm_nested_cv(s, d):
    return decoding.nested_summary(decoding.nested(_samples(s, d), folds.modulo_folds(fx.trials(s, d), 5)))


def _movie_samples(s, d):
    """Frames 2 to 5 of each trial's whole image, pixel by frame, as one sample of 256 features."""
    cube = fx.movies(s, d).where("frame between 2 and 5")
    ordered = F.array_sort(F.collect_list(F.struct("frame", "pixel", "value")))
    whole = cube.groupBy("trial", "y").agg(ordered.alias("v")).where(F.size("v") == 4 * 64)
    return whole.select("trial", F.lit(2).alias("frame"), "y", F.transform("v", lambda c: c["value"]).alias("features"))


def svm_wide_window(s, d):
    samples = _movie_samples(s, d)
    return decoding.cross_validate(samples, folds.modulo_folds(samples.select("trial"), 5), 0.01)


def svm_wide_nested(s, d):
    samples = _movie_samples(s, d)
    return decoding.nested_record(samples, folds.modulo_folds(samples.select("trial"), 5))["summary"]


def svm_wide_weights(s, d):
    return decoding.final_model(_movie_samples(s, d), 0.01)


def _in_blocks(trials):
    """A splitter of one's own: folds of neighbouring trials."""
    return trials.select("trial", F.floor(F.col("trial") / 100 % 5).cast("int").alias("fold"))


def ridge_in_blocks(s, d):
    split = folds.splits(fx.trials(s, d), _in_blocks)
    return decoding.cross_validate(_samples(s, d), split, 0.1, Ridge())


def svm_sliding_window(s, d):
    samples = decoding.window_samples(features.in_region(fx.dense(s, d), fx.roi(s)), 5, 1, 10, 3)
    return decoding.sliding_curve(decoding.sliding_decode(samples, folds.modulo_folds(fx.trials(s, d), 5)))


def svm_permutation_sliding(s, d):
    samples = decoding.window_samples(features.in_region(fx.dense(s, d), fx.roi(s)), 5, 1, 10, 3)
    split = folds.modulo_folds(fx.trials(s, d), 5)
    null = decoding.sliding_permutations(samples, split, significance.permuted_labels(fx.trials(s, d), 20))
    return decoding.sliding_significance(null, decoding.sliding_decode(samples, split), 0.05)


def svm_permutation_fixed(s, d):
    null = decoding.fixed_permutations(_samples(s, d), folds.modulo_folds(fx.trials(s, d), 5), significance.permuted_labels(fx.trials(s, d), 4), 3, (1e-4, 1e-2))
    return null.groupBy("perm").agg(F.avg("frame_acc").alias("frame_acc"), F.avg("trial_acc").alias("trial_acc"))


def svm_final_model(s, d):
    return decoding.final_model(_samples(s, d), 0.01)


def svm_weight_map(s, d):
    return weights.weight_stats(weights.features_to_pixels(decoding.fold_weights(_samples(s, d), folds.modulo_folds(fx.trials(s, d), 5), 0.01).where("feature >= 0").select("feature", "w", "fold"), fx.roi(s)).withColumn("fold", F.lit(0)))


_P, _W = fx.with_tables("predictions"), fx.with_tables("weights")
_NULLS = fx.with_tables("trials", "predictions", "perms", "null_scores", "real_scores")
_VOTE = """v AS (SELECT fold, trial, CAST(sum(y_pred) * 2 > count(*) AS INTEGER) AS y_pred, min_by(y_true, frame) AS y_true FROM predictions GROUP BY fold, trial)"""
_AUC = """a AS (SELECT fold, y_true, rank() OVER w + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS r FROM predictions WINDOW w AS (PARTITION BY fold ORDER BY score)),
    auc AS (SELECT fold, (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE) / nullif(CAST(sum(y_true) * (count(*) - sum(y_true)) AS DOUBLE), 0) AS auc FROM a GROUP BY fold)"""
_FM = f"""{_P}, {_VOTE}, {_AUC}, fm AS (SELECT fold, acc, n_test, auc, acc_trial FROM (SELECT fold, avg(CAST(y_pred = y_true AS DOUBLE)) AS acc, count(*) AS n_test FROM predictions GROUP BY fold)
    JOIN auc USING (fold) JOIN (SELECT fold, avg(CAST(y_pred = y_true AS DOUBLE)) AS acc_trial FROM v GROUP BY fold) USING (fold))"""
_GRID = f"{fx.with_tables('predictions', 'c_grid')}, g AS (SELECT c, avg(metric) AS mean, stddev_samp(metric) / sqrt(count(*)) AS se FROM c_grid GROUP BY c)"
_CHOICE = f"{fx.with_tables('predictions', 'c_grid')}, ch AS (SELECT c FROM c_grid QUALIFY row_number() OVER (PARTITION BY fold ORDER BY metric DESC, c DESC) = 1)"
_ROC = f"""{_P}, q AS (SELECT score, sum(y_true) AS pos, count(*) AS n FROM predictions GROUP BY score),
    roc AS (SELECT score AS threshold, (sum(n) OVER w - sum(pos) OVER w) / CAST(sum(n - pos) OVER () AS DOUBLE) AS fpr, sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr FROM q WINDOW w AS (ORDER BY score DESC)
    UNION ALL SELECT NULL, 0, 0)"""
_FIX = f"""{_NULLS}, nl AS (SELECT avg(score) AS score FROM null_scores GROUP BY perm), re AS (SELECT avg(score) AS real FROM real_scores),
    fx AS (SELECT max(real) AS real, (sum(CAST(round(score, 12) >= round(real, 12) AS INTEGER)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p1,
    (sum(CAST(round(abs(score - 0.5), 12) >= round(abs(real - 0.5), 12) AS INTEGER)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p2,
    avg(score) AS m, stddev_samp(score) AS sd, min(score) AS lo, max(score) AS hi, count(*) AS n FROM nl, re)"""
_BH = """SELECT *, least(1.0::DOUBLE, min(q) OVER (PARTITION BY 1 ORDER BY p DESC, q ROWS UNBOUNDED PRECEDING)) AS p_fdr FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM {0})"""
_RANKS = f"""{_NULLS}, both_ AS (SELECT frame AS "window", avg(CAST(y_pred = y_true AS DOUBLE)) AS score, 1 AS own FROM predictions GROUP BY frame, fold UNION ALL SELECT "window", score, 0 FROM null_scores),
    rk AS (SELECT "window", own, rank() OVER (PARTITION BY "window" ORDER BY score) + (count(*) OVER (PARTITION BY "window", score) - 1) / 2.0::DOUBLE AS r, CAST(count(*) OVER (PARTITION BY "window", score) AS DOUBLE) AS t FROM both_),
    st AS (SELECT "window", sum(r) FILTER (own = 1) AS r, CAST(sum(own) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS ties FROM rk GROUP BY "window"),
    us AS (SELECT "window", r - n1 * (n1 + 1) / 2 AS u, r - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 AS dd, sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM st)"""
def _exact_sql(two_sided: bool) -> str:
    """Counts all ways to choose the own ranks; the normal approximation where a value repeats."""
    above, below = (f"count(*) FILTER (b.r {side} us.r) / CAST(count(*) AS DOUBLE)" for side in (">=", "<="))
    z = "((abs(dd) - 0.5) / sd)" if two_sided else "((dd - 0.5) / sd)"
    normal = f"CASE WHEN sd > 0 THEN least(1, {'2 * ' if two_sided else ''}{normal_tail_sql(z)}) ELSE 1 END"
    return f"""{_P}, both_ AS (SELECT trial // 16 AS "window", score, CAST(trial % 16 < 6 AS INTEGER) AS own FROM predictions WHERE frame = 0),
    rk AS (SELECT "window", own, rank() OVER (PARTITION BY "window" ORDER BY score) + (count(*) OVER (PARTITION BY "window", score) - 1) / 2.0::DOUBLE AS r, CAST(count(*) OVER (PARTITION BY "window", score) AS DOUBLE) AS t FROM both_),
    st AS (SELECT "window", coalesce(sum(r) FILTER (own = 1), 0) AS r, CAST(sum(own) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS ties FROM rk GROUP BY "window"),
    us AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, r - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 AS dd, sqrt(n1 * (n - n1) / 12 * (n + 1 - CASE WHEN n > 1 THEN ties / (n * (n - 1)) ELSE 0 END)) AS sd FROM st),
    b AS (SELECT m, bit_count(m) AS k, coalesce(list_sum(list_filter(range(1, 17), lambda i: (m >> (i - 1)) % 2 = 1)), 0) AS r FROM (SELECT CAST(range AS INTEGER) AS m FROM range(65536))),
    x AS (SELECT us."window", {f"least(1, 2 * least({above}, {below}))" if two_sided else above} AS p FROM us JOIN b ON b.k = us.n1 AND b.m < pow(2, us.n) GROUP BY us."window", us.r)
    SELECT CAST(us."window" AS INTEGER) AS "window", u, round(CASE WHEN ties = 0 THEN x.p ELSE {normal} END, 8) AS p FROM us JOIN x ON us."window" = x."window\""""


_MW = f'{_W}, mw AS (SELECT "window", pixel, avg(w) AS w FROM weights GROUP BY ALL)'
_W0 = f"{_W}, m0 AS (SELECT pixel, avg(w) AS w, stddev_samp(w) AS std FROM weights GROUP BY pixel)"


def _masks(source: str, frac: float, keys: str, strict: bool = True) -> str:
    on = f"({keys})" if keys else ""
    cut = lambda sign, p: f"quantile_cont(w, {p})" + (f" FILTER (w {sign} 0)" if strict else "")
    group, join = (f"{keys}, ", f"JOIN k USING {on}") if keys else ("", ", k")
    mark = lambda sign, c: f"coalesce({f'w {sign} 0 AND ' if strict else ''}{c}, false)"
    return f"""k AS (SELECT {group}{cut(">", 1 - frac)} AS pos_cut, {cut("<", frac)} AS neg_cut FROM {source} {f"GROUP BY {keys}" if keys else ""}),
        mk AS (SELECT {group}pixel, w, pos_cut, neg_cut, {mark(">", "w >= pos_cut")} AS pos_mask, {mark("<", "w <= neg_cut")} AS neg_mask FROM {source} {join})"""


_SHOW = "round(w, 6) AS w, round(pos_cut, 6) AS pos_cut, round(neg_cut, 6) AS neg_cut, pos_mask, neg_mask FROM mk"
_SUMMARY = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in ("acc", "auc", "acc_trial"))

ORACLES = {
    "majority_vote": f"{_P}, {_VOTE} SELECT fold, trial, y_pred, y_true FROM v",
    "frame_accuracy": f"{_P} SELECT fold, round(avg(CAST(y_pred = y_true AS DOUBLE)), 6) AS acc, count(*) AS n_test FROM predictions GROUP BY fold",
    "trial_accuracy": f"{_P}, {_VOTE} SELECT fold, round(avg(CAST(y_pred = y_true AS DOUBLE)), 6) AS acc, count(*) AS n_test FROM v GROUP BY fold",
    "fold_metrics": f"{_FM} SELECT fold, round(acc, 6) AS acc, n_test, round(auc, 6) AS auc, round(acc_trial, 6) AS acc_trial FROM fm",
    "fold_summary": f"{_FM} SELECT {_SUMMARY} FROM fm",
    "confusion_counts": f"{_P} SELECT CAST(a AS INTEGER) AS y_true, CAST(b AS INTEGER) AS y_pred, count(trial) AS n FROM range(0, 2) r(a), range(0, 2) q(b) LEFT JOIN predictions ON y_true = a AND y_pred = b GROUP BY a, b",
    "confusion_normalized": f"""{_P}, c AS (SELECT CAST(a AS INTEGER) AS y_true, CAST(b AS INTEGER) AS y_pred, count(trial) AS n FROM range(0, 2) r(a), range(0, 2) q(b) LEFT JOIN predictions ON y_true = a AND y_pred = b GROUP BY a, b)
        SELECT *, round(n / CAST(greatest(sum(n) OVER (PARTITION BY y_true), 1) AS DOUBLE), 6) AS share FROM c""",
    "out_of_fold": f"{_P} SELECT trial, frame, y_true, CASE WHEN fold < 8 THEN fold END AS fold, CASE WHEN fold < 8 THEN y_pred END AS y_pred, round(CASE WHEN fold < 8 THEN score END, 6) AS score FROM predictions",
    "roc_auc": f"""{_P}, a AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM predictions)
        SELECT round((sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE) / CAST(sum(y_true) * (count(*) - sum(y_true)) AS DOUBLE), 6) AS auc FROM a""",
    "roc_auc_by_fold": f"{_P}, {_AUC} SELECT fold, round(auc, 6) AS auc FROM auc",
    "roc_curve": f"{_ROC} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc",
    "roc_curve_area": f"{_ROC} SELECT round(sum(a), 6) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY fpr, tpr))",
    "sem_by_fold": f"{_P} SELECT fold, round(stddev_samp(score) / sqrt(count(score)), 6) AS sem FROM predictions GROUP BY fold",
    "metric_histogram": f"""{_NULLS}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM null_scores), h AS (SELECT CAST(least(floor((score - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM null_scores, e GROUP BY 1)
        SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 30), 6) AS low, round(lo + (b + 1) * ((hi - lo) / 30), 6) AS high, coalesce(n, 0) AS n FROM range(0, 30) r(b) LEFT JOIN h ON bin = b, e""",
    "peak_window": f"{_P}, c AS (SELECT frame + 3 AS center, avg(CAST(y_pred = y_true AS DOUBLE)) AS acc FROM predictions GROUP BY frame) SELECT round(acc, 6) AS peak, center AS at FROM c ORDER BY acc DESC, center LIMIT 1",
    "select_c_one_se": f"{_GRID}, b AS (SELECT * FROM g ORDER BY mean DESC, c LIMIT 1) SELECT round(min(g.c), 6) AS c FROM g, b WHERE round(g.mean, 12) >= round(b.mean - coalesce(b.se, 0), 12)",
    "select_c_best": f"{_GRID} SELECT round(max(c), 6) AS c FROM g WHERE round(mean, 12) >= (SELECT round(max(mean) - min(se), 12) FROM g)",
    "final_c_mode_median": f"{_CHOICE}, n AS (SELECT c, count(*) AS k FROM ch GROUP BY c) SELECT round(median(c), 6) AS c FROM n WHERE k = (SELECT max(k) FROM n)",
    "final_c_median": f"{_CHOICE} SELECT round(median(c), 6) AS c FROM ch",
    "permute_labels": f"{fx.with_tables('trials', 'perms')} SELECT perm, trial, y_perm FROM perms",
    "perm_null_scores": f'{_NULLS} SELECT perm, "window", round(score, 6) AS score FROM null_scores',
    "perm_pvalue_one_tailed": f"""{_FIX} SELECT round(real, 6) AS real, round(p1, 6) AS p_one_tailed, round(m, 6) AS null_mean, round(sd, 6) AS null_std, p1 < 0.05 AS pass_one_tailed,
        CASE WHEN p1 <= 1.0::DOUBLE / (n + 1) THEN printf('p < %.4f', 1.0::DOUBLE / (n + 1)) ELSE printf('p = %.4f', p1) END AS text FROM fx""",
    "perm_pvalue_two_tailed": f"{_FIX} SELECT round(p2, 6) AS p_two_tailed, round(lo, 6) AS null_min, round(hi, 6) AS null_max, p2 < 0.05 AS pass_two_tailed FROM fx",
    "window_perm_pvalues": f"""{_NULLS}, wp AS (SELECT n."window", max(r.score) AS real, (sum(CAST(round(abs(n.score - 0.5), 12) >= round(abs(r.score - 0.5), 12) AS INTEGER)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p
        FROM null_scores n JOIN real_scores r USING ("window") GROUP BY ALL) SELECT "window", round(real, 6) AS real, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr, p_fdr < 0.05 AS significant FROM ({_BH.format("wp")})""",
    "bh_fdr": f"{_W}, b AS (SELECT pixel, abs(avg(w)) AS p FROM weights GROUP BY pixel) SELECT pixel, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM ({_BH.format('b')})",
    "ranksum_by_window": f"""{_RANKS}, zz AS (SELECT "window", u, (dd - 0.5) / sd AS z FROM us) SELECT "window", u, round(z, 5) AS z, round(least(1, {normal_tail_sql("z")}), 5) AS p FROM zz""",
    "ranksum_exact": _exact_sql(False),
    "ranksum_exact_two_sided": _exact_sql(True),
    "ranksum_two_sided": f"""{_RANKS}, zz AS (SELECT "window", u, (abs(dd) - 0.5) / sd AS z FROM us) SELECT "window", u, round(z, 5) AS z, round(least(1, 2 * {normal_tail_sql("z")}), 5) AS p FROM zz""",
    "null_band": f'{_NULLS} SELECT "window", round(avg(score), 6) AS mean, round(avg(score) - 3 * stddev_samp(score), 6) AS low, round(avg(score) + 3 * stddev_samp(score), 6) AS high FROM null_scores GROUP BY "window"',
    "weight_stats": f"""{_W}, m AS (SELECT "window", pixel, avg(w) AS w, stddev_samp(w) AS std FROM weights GROUP BY "window", pixel)
        SELECT "window", pixel, round(w, 6) AS mean, round(std, 6) AS std, round(abs(w), 6) AS abs_mean, CAST(sign(w) AS DOUBLE) AS sign, round(w / max(abs(w)) OVER (PARTITION BY "window"), 6) AS scaled FROM m""",
    "weight_image": f"{_W0} SELECT pixel, round(CASE WHEN pixel IN (0, 1, 3) THEN w END, 6) AS w FROM m0",
    "weight_pixel_time": f'{_MW} SELECT pixel, "window", round(CASE WHEN pixel IN (0, 1, 3) THEN w END, 6) AS w FROM mw',
    "extreme_masks": f"{_W0}, {_masks('m0', 0.2, '')} SELECT pixel, {_SHOW}",
    "extreme_masks_sliding": f"""{_MW}, {_masks("mw", 0.2, '"window"')} SELECT "window", pixel, {_SHOW}""",
    "extreme_masks_nonstrict": f"""{_MW}, {_masks("mw", 0.2, '"window"', False)} SELECT "window", pixel, {_SHOW}""",
    "pos_neg_timecourse": f"""{_MW}, m0 AS (SELECT pixel, avg(w) AS w FROM weights GROUP BY pixel), {_masks("m0", 0.3, "")}
        SELECT CAST(CASE WHEN pos_mask THEN 1 ELSE -1 END AS INTEGER) AS sign, mw."window" AS frame, round(avg(mw.w), 6) AS mean FROM mw JOIN mk USING (pixel) WHERE pos_mask OR neg_mask GROUP BY 1, 2""",
    "clip_limits": f"{_W} SELECT round(-max(abs(w)), 6) AS low, round(max(abs(w)), 6) AS high FROM weights",
    "clip_limits_percentile": f"{_W} SELECT round(-quantile_cont(abs(w), 0.9), 6) AS low, round(quantile_cont(abs(w), 0.9), 6) AS high FROM weights",
    "movie_status": f"""{_P}, {_VOTE}, o AS (SELECT round(avg(CAST(y_pred = y_true AS DOUBLE)), 3) AS tr FROM v), c AS (SELECT frame AS "window", frame + 3 AS center, round(avg(CAST(y_pred = y_true AS DOUBLE)), 3) AS acc FROM predictions GROUP BY frame)
        SELECT "window", printf('window %d/%d | center %d | frame %.3f | trial %.3f', "window" + 1, count(*) OVER (), center, acc, tr) AS status FROM c, o""",
    "ranksum_adjusted": f"""{_RANKS}, zz AS (SELECT "window", u, (dd - 0.5) / sd AS z FROM us), pz AS (SELECT "window", u, z, least(1, {normal_tail_sql("z")}) AS p FROM zz)
        SELECT "window", u, round(z, 5) AS z, round(p, 5) AS p, round(p_fdr, 5) AS p_fdr, p_fdr < 0.05 AS significant FROM ({_BH.format("pz")})""",
    "significance_head": f"""{_NULLS}, wp AS (SELECT n."window", max(r.score) AS real, (sum(CAST(round(abs(n.score - 0.5), 12) >= round(abs(r.score - 0.5), 12) AS INTEGER)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p
        FROM null_scores n JOIN real_scores r USING ("window") GROUP BY ALL) SELECT "window", round(real, 6) AS real, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr, p_fdr < 0.05 AS significant FROM ({_BH.format("wp")}) WHERE "window" < 5""",
    "run_time_suffix": """SELECT DISTINCT concat('sliding__tag____', strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d_%H-%M-%S')) AS name, strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at FROM lineitem""",
    "perm_summary_schema": f"{_NULLS} SELECT CAST(perm AS VARCHAR) AS run_id, round(avg(score), 6) AS shuffled_trial_mean, round(stddev_samp(score), 6) AS shuffled_trial_std, round(max(score), 6) AS shuffled_trial_max FROM null_scores GROUP BY perm",
    "sliding_record_curves": f"""{_NULLS}, b AS (SELECT "window", round(avg(score), 6) AS m, round(stddev_pop(score), 6) AS sd FROM null_scores GROUP BY "window")
        SELECT CAST(row_number() OVER (ORDER BY "window") - 1 AS INTEGER) AS "window", CAST("window" + 2 AS INTEGER) AS center, round(score, 6) AS real_trial_curve, round(score, 6) AS real_frame_curve,
        m AS null_trial_mean, sd AS null_trial_std, m AS null_frame_mean, sd AS null_frame_std FROM b JOIN real_scores USING ("window")""",
    "sliding_record_null": f"""{_NULLS} SELECT CAST(dense_rank() OVER (ORDER BY perm) - 1 AS INTEGER) AS perm, CAST(dense_rank() OVER (ORDER BY "window") - 1 AS INTEGER) AS "window",
        CAST("window" + 2 AS INTEGER) AS center, round(score, 6) AS trial_acc, round(1 - score, 6) AS frame_acc FROM null_scores""",
    "fixed_record": f"""{_NULLS}, n AS (SELECT perm, avg(score) AS t FROM null_scores GROUP BY perm), r AS (SELECT avg(score) AS m, stddev_samp(score) AS sd FROM real_scores),
        q AS (SELECT (sum(CAST(round(abs(t - 0.5), 12) >= round(abs(m - 0.5), 12) AS INTEGER)) + 1) / (count(*) + 1) AS p FROM n, r)
        SELECT round(m, 6) AS real_trial_acc, round(sd, 6) AS real_trial_std, round(avg(t), 6) AS shuffled_trial_mean, round(stddev_samp(t), 6) AS shuffled_trial_std, round(min(t), 6) AS shuffled_trial_min,
        round(max(t), 6) AS shuffled_trial_max, round(p, 6) AS p_value_trial_two_tailed, p < 0.05 AS pass_alpha_0p05_trial, round(1 - m, 6) AS real_frame_acc, round(sd, 6) AS real_frame_std FROM n, r, q GROUP BY m, sd, p""",
    "run_name_parse": """WITH n AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 1 THEN concat('sliding_window_', '_', l_partkey, lower(l_returnflag), l_suppkey, '_frame1-100') ELSE 'run without token' END AS name FROM lineitem)
        SELECT name, regexp_extract(name, '_(\\d+)([A-Za-z])(\\d+)_', 1) AS date, regexp_extract(name, '_(\\d+)([A-Za-z])(\\d+)_', 2) AS session,
        array_to_string(string_split(regexp_extract(name, '_(\\d+)([A-Za-z])(\\d+)_', 3), ''), ',') AS conditions FROM n""",
    "file_catalog": f"{fx.with_tables('sparse')} SELECT DISTINCT lower(session) AS session, cond, concat('/data/conds', cond, '_', lower(session), '.npy') AS path FROM sparse",
    "perm_schema_coalesce": f"{_NULLS} SELECT perm, round(avg(score), 6) AS trial_score, round(CASE WHEN perm < 10 THEN max(score) END, 6) AS frame_score FROM null_scores GROUP BY perm",
}
ROWS_ONLY = ("svm_fixed_window", "svm_nested_cv", "svm_sliding_window", "svm_permutation_sliding", "svm_permutation_fixed", "svm_final_model", "svm_weight_map", "svm_wide_window", "svm_wide_nested", "svm_wide_weights", "ridge_in_blocks")
QUERIES = {k: v for k, v in globals().items() if k in ORACLES or k in ROWS_ONLY}
