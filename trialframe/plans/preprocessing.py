"""Registered queries: normalisation, selection, reshaping, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import ms_axis
from ..operators import features, folds, normalize
from ..sources import fixtures as fx
from ..sources import runs

BASE = (0, 4)


def _r(df, **columns):
    """Columns of df, those given rounded to that many places."""
    return df.select(*[F.round(c, columns[c]).alias(c) if c in columns else c for c in df.columns])


def zscore_pooled(s, d):
    return _r(normalize.zscore_pooled(fx.dense(s, d), BASE).select("trial", "pixel", "frame", "z"), z=6)


def zscore_per_trial(s, d):
    return _r(normalize.zscore_per_trial(fx.dense(s, d), BASE).select("trial", "pixel", "frame", "z"), z=6)


def zscore_baseline_check(s, d):
    return _r(normalize.baseline_check(normalize.zscore_pooled(fx.dense(s, d), BASE), BASE), mean=6, std=6)


def frame_zero_normalize(s, d):
    return _r(normalize.frame_zero(fx.sparse(s, d), frames=[5, 6, 7]), value=6)


def blank_normalize(s, d):
    return _r(normalize.blank(fx.sparse(s, d), fx.BLANK), value=6)


def sessions_without_blank(s, d):
    return normalize.sessions_without_blank(fx.sparse_without_blank(s, d), fx.BLANK)


def balance_classes(s, d):
    return features.balanced(fx.trials(s, d))


def pairwise_dataset(s, d):
    return _r(features.pairwise_dataset(fx.sparse(s, d), 1, 4, ("session",)).select("session", "trial", "y", "frame", "pixel", "value"), value=6)


def dataset_from_config(s, d):
    """The data set that each session's configuration describes, z-scored over its baseline."""
    cube = fx.sparse(s, d)
    text = F.format_string('{"face_file": "conds1_%s.npy", "nonface_file": "conds4_%s.npy", "zscore_baseline_frames": [0, 6]}', "session", "session")
    configs = runs.parse_configs(cube.select("session").distinct().select(F.col("session").alias("run_id"), text.alias("json")))
    return _r(runs.datasets_of(configs, cube).select("session", "trial", "y", "frame", "pixel", "z"), z=5)


def roi_semi_join(s, d):
    return _r(features.in_region(fx.dense(s, d), fx.roi(s)).select("trial", "y", "frame", "pixel", "value"), value=6)


def roi_anti_join(s, d):
    return _r(features.outside_region(fx.dense(s, d), fx.roi(s)).select("trial", "y", "frame", "pixel", "value"), value=6)


def roi_polygon(s, d):
    pixels = fx.dense(s, d).groupBy("pixel").agg(F.count(F.lit(1)).alias("cells"))
    return features.region_from_polygon([(0.2, 0.2), (1.9, 0.3), (0.3, 1.8)], 2, pixels).join(pixels, "pixel")


def extract_window(s, d):
    return _r(features.extract_window(fx.dense(s, d), 4, 9, fx.DENSE_FRAMES).select("trial", "frame", "pixel", "value"), value=6)


def window_average(s, d):
    return _r(features.window_average(fx.dense(s, d), 4, 9), value=6)


def frames_as_samples_stats(s, d):
    x = features.frames_as_samples(fx.dense(s, d).where("frame >= 4 and frame < 9"), 4, 5)
    return x.select("sample_id", "trial", "frame", "y", *[F.round(F.element_at("features", k + 1), 6).alias(f"f{k}") for k in range(4)], F.size("features").alias("n_features"))


def relative_change(s, d):
    return _r(features.relative_change(fx.dense(s, d)).select("trial", "frame", "pixel", "value"), value=6)


def keep_or_null(s, d):
    return _r(features.keep_or_null(fx.dense(s, d), fx.roi(s)).select("trial", "frame", "pixel", "value"), value=6)


def ms_axis_curve(s, d):
    return _r(fx.dense(s, d).groupBy("frame").agg(F.avg("value").alias("mean")).select(ms_axis(F.col("frame"), 4).alias("ms"), "mean"), mean=6)


def superpixel_mean(s, d):
    wide = fx.weights(s, d).withColumnRenamed("w", "value")
    return _r(features.superpixels(wide, 3, 8, 8, ("window",)), mean=6)


def time_bin_mean(s, d):
    return _r(features.time_bins(fx.dense(s, d), 3, 0, fx.DENSE_FRAMES), mean=6)


def sliding_windows(s, d):
    first, last = features.window_starts(fx.DENSE_FRAMES, 5, 1, 14, 2)
    return features.sliding_windows(fx.dense(s, d), 5, first, last, 2).groupBy("window", "center").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("cells"))


def window_activation_curve(s, d):
    """Region, pooled z-score, sliding windows, mean activation per class: the flagship query."""
    cube = normalize.zscore_pooled(features.in_region(fx.dense(s, d), fx.roi(s)), BASE)
    first, last = features.window_starts(fx.DENSE_FRAMES, 5, 1, fx.DENSE_FRAMES)
    return _r(features.window_means(cube, "z", 5, first, last, keys=("y",)), mean=6)


def fold_assign_modulo(s, d):
    return folds.modulo_folds(fx.trials(s, d), 7)


def fold_assign_greedy(s, d):
    sizes = fx.sparse(s, d).groupBy((F.col("trial") * 10 + F.col("cond")).cast("long").alias("trial")).agg(F.count(F.lit(1)).alias("n"))
    return folds.greedy_folds(sizes, 4).groupBy("fold").agg(F.count(F.lit(1)).alias("trials"))


def fold_coverage(s, d):
    p = fx.predictions(s, d).select((F.col("trial") * 8 + F.col("frame")).alias("sample_id"))
    return folds.coverage(p)


def group_pair_out(s, d):
    return folds.leave_pair_out(fx.trials(s, d))


def label_purity(s, d):
    return folds.impure_groups(fx.sparse(s, d).select("trial", F.col("cond").alias("y")))


def split_matrix(s, d):
    t = fx.trials(s, d)
    return folds.split_matrix(t, folds.modulo_folds(t, 5), 5)


def bad_splits(s, d):
    t = fx.trials(s, d)
    return folds.bad_splits(t, folds.modulo_folds(t, 7), 12)


def minmax_scale(s, d):
    return _r(normalize.min_max_scaled(fx.weights(s, d), "w", "scaled", ["window"]).select("fold", "window", "pixel", "scaled"), scaled=6)


def factorise(s, d):
    return normalize.factorised(fx.sparse(s, d).groupBy("session").agg(F.count(F.lit(1)).alias("cells")), "session", "code")


_Z = """SELECT trial, pixel, frame, round((value - mu) / greatest(sd, 1e-8), 6) AS z FROM zs"""
_ZS = """cs AS (SELECT *, avg(value) FILTER (frame < 4) OVER (PARTITION BY pixel, trial) AS mu FROM {0}),
    zs AS (SELECT *, stddev_pop(value - mu) FILTER (frame < 4) OVER (PARTITION BY pixel) AS sd FROM cs)"""

_PAIRS = """two AS (SELECT *, CASE WHEN cond = 1 THEN 1 ELSE 0 END AS y FROM sparse WHERE cond IN (1, 4)),
    t AS (SELECT DISTINCT session, trial, y FROM two), r AS (SELECT *, row_number() OVER (PARTITION BY session, y ORDER BY trial) AS k FROM t),
    n AS (SELECT session, min(c) AS n FROM (SELECT session, count(*) AS c FROM t GROUP BY session, y) GROUP BY session),
    pw AS (SELECT session, CAST(k - 1 + CASE WHEN y = 1 THEN 0 ELSE n END AS INTEGER) AS trial, y, frame, pixel, value FROM two JOIN r USING (session, trial, y) JOIN n USING (session) WHERE k <= n)"""
#: The edges of the polygon of roi_polygon.
_EDGES = "(VALUES (0.2e0, 0.2e0, 1.9e0, 0.3e0), (1.9e0, 0.3e0, 0.3e0, 1.8e0), (0.3e0, 1.8e0, 0.2e0, 0.2e0)) e(x1, y1, x2, y2)"

ORACLES = {
    "zscore_pooled": f"{fx.with_tables('dense')}, {_ZS.format('dense')} {_Z}",
    "zscore_per_trial": f"""{fx.with_tables("dense")} SELECT trial, pixel, frame, round((value - avg(value) FILTER (frame < 4) OVER w)
        / greatest(stddev_pop(value) FILTER (frame < 4) OVER w, 1e-6), 6) AS z FROM dense WINDOW w AS (PARTITION BY pixel, trial)""",
    "zscore_baseline_check": f"""{fx.with_tables("dense")}, {_ZS.format("dense")}, z AS (SELECT frame, (value - mu) / greatest(sd, 1e-8) AS z FROM zs)
        SELECT round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std FROM z WHERE frame < 4""",
    "frame_zero_normalize": f"""{fx.with_tables("sparse")}, b AS (SELECT *, avg(value) FILTER (frame IN (5, 6, 7)) OVER (PARTITION BY session, cond, pixel, trial) AS m FROM sparse)
        SELECT session, cond, trial, frame, pixel, round(CASE WHEN m IS NOT NULL AND sign(m + 1e-12) <> 0 THEN value / (greatest(abs(m), 1e-12) * sign(m + 1e-12)) END, 6) AS value FROM b""",
    "blank_normalize": f"""{fx.with_tables("sparse")}, b AS (SELECT *, avg(value) FILTER (cond = 3) OVER (PARTITION BY session, pixel, frame) AS m FROM sparse)
        SELECT session, cond, trial, frame, pixel, round(CASE WHEN cond = 3 THEN value ELSE value / (CASE WHEN abs(m) < 1e-12 THEN 1e-12 ELSE m END) END, 6) AS value FROM b""",
    "sessions_without_blank": f"""{fx.with_tables("sparse")} SELECT session FROM sparse WHERE session <> 'A' OR cond <> 3 GROUP BY session HAVING count(*) FILTER (cond = 3) = 0""",
    "balance_classes": f"""{fx.with_tables("trials")}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY trial) AS k FROM trials),
        n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM trials GROUP BY y))
        SELECT trial, y, CAST(k - 1 + CASE WHEN y = 1 THEN 0 ELSE n END AS INTEGER) AS "index" FROM r, n WHERE k <= n""",
    "pairwise_dataset": f"{fx.with_tables('sparse')}, {_PAIRS} SELECT session, trial, y, frame, pixel, round(value, 6) AS value FROM pw",
    "dataset_from_config": f"""{fx.with_tables("sparse")}, {_PAIRS}, cs AS (SELECT *, avg(value) FILTER (frame < 6) OVER (PARTITION BY session, pixel, trial) AS mu FROM pw),
        zs AS (SELECT *, stddev_pop(value - mu) FILTER (frame < 6) OVER (PARTITION BY session, pixel) AS sd FROM cs)
        SELECT session, trial, y, frame, pixel, round((value - mu) / greatest(sd, 1e-8), 5) AS z FROM zs""",
    "roi_semi_join": f"{fx.with_tables('dense', 'roi')} SELECT trial, y, frame, pixel, round(value, 6) AS value FROM dense WHERE pixel IN (SELECT pixel FROM roi)",
    "roi_anti_join": f"{fx.with_tables('dense', 'roi')} SELECT trial, y, frame, pixel, round(value, 6) AS value FROM dense WHERE pixel NOT IN (SELECT pixel FROM roi)",
    "roi_polygon": f"""{fx.with_tables("dense")}, p AS (SELECT pixel, count(*) AS cells, pixel % 2 + 0.5e0 AS px, pixel // 2 + 0.5e0 AS py FROM dense GROUP BY pixel)
        SELECT pixel, cells FROM p, {_EDGES} GROUP BY pixel, cells HAVING count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (py - y1) * (x2 - x1) / (y2 - y1) + x1) % 2 = 1""",
    "extract_window": f"{fx.with_tables('dense')} SELECT trial, frame, pixel, round(value, 6) AS value FROM dense WHERE frame >= 4 AND frame < 9",
    "window_average": f"{fx.with_tables('dense')} SELECT trial, pixel, round(avg(value), 6) AS value FROM dense WHERE frame >= 4 AND frame < 9 GROUP BY trial, pixel",
    "frames_as_samples_stats": f"""{fx.with_tables("dense")} SELECT trial * 5 + frame - 4 AS sample_id, trial, frame, y, round(max(value) FILTER (pixel = 0), 6) AS f0, round(max(value) FILTER (pixel = 1), 6) AS f1,
        round(max(value) FILTER (pixel = 2), 6) AS f2, round(max(value) FILTER (pixel = 3), 6) AS f3, CAST(count(*) AS INTEGER) AS n_features FROM dense WHERE frame >= 4 AND frame < 9 GROUP BY trial, frame, y""",
    "relative_change": f"{fx.with_tables('dense')} SELECT trial, frame, pixel, round(value - 1, 6) AS value FROM dense",
    "keep_or_null": f"{fx.with_tables('dense', 'roi')} SELECT trial, frame, pixel, round(CASE WHEN pixel IN (SELECT pixel FROM roi) THEN value END, 6) AS value FROM dense",
    "ms_axis_curve": f"{fx.with_tables('dense')} SELECT (frame - 4) * 10 AS ms, round(avg(value), 6) AS mean FROM dense GROUP BY frame",
    "superpixel_mean": f"""{fx.with_tables("weights")}, p AS (SELECT "window", w, CAST((pixel % 8) // 2 AS INTEGER) AS col, CAST((pixel // 8) // 2 AS INTEGER) AS row FROM weights)
        SELECT row, col, "window", round(avg(w), 6) AS mean, row * 4 + col AS plot FROM p WHERE col < 4 AND row < 4 GROUP BY row, col, "window" """,
    "time_bin_mean": f"{fx.with_tables('dense')} SELECT CAST(frame // 3 AS INTEGER) AS bin, pixel, round(avg(value), 6) AS mean, min(frame) AS first_frame FROM dense WHERE frame < 15 GROUP BY 1, 2",
    "sliding_windows": f"""{fx.with_tables("dense")}, w AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS "window") SELECT "window", 1 + 2 * "window" + 2 AS center, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS cells
        FROM dense JOIN w ON frame >= 1 + 2 * "window" AND frame < 6 + 2 * "window" GROUP BY "window" """,
    "window_activation_curve": f"""{fx.with_tables("dense", "roi")}, r AS (SELECT * FROM dense WHERE pixel IN (SELECT pixel FROM roi)), {_ZS.format("r")}, w AS (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS "window")
        SELECT "window", "window" + 3 AS center, y, round(avg((value - mu) / greatest(sd, 1e-8)), 6) AS mean FROM zs JOIN w ON frame >= "window" + 1 AND frame < "window" + 6 GROUP BY "window", y""",
    "fold_assign_modulo": f"{fx.with_tables('trials')} SELECT trial, CAST((row_number() OVER (ORDER BY trial) - 1) % 7 AS INTEGER) AS fold FROM (SELECT DISTINCT trial FROM trials)",
    "fold_coverage": f"{fx.with_tables('predictions')} SELECT times, count(*) AS samples FROM (SELECT count(*) AS times FROM predictions GROUP BY trial * 8 + frame) GROUP BY times",
    "group_pair_out": f"""{fx.with_tables("trials")}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY y ORDER BY md5(concat('0:', CAST(trial AS VARCHAR)))) - 1 AS INTEGER) AS fold FROM trials)
        SELECT trial, y, fold FROM r WHERE fold IN (SELECT fold FROM r GROUP BY fold HAVING count(DISTINCT y) = 2)""",
    "label_purity": f"{fx.with_tables('sparse')} SELECT trial, count(DISTINCT cond) AS labels FROM sparse GROUP BY trial HAVING count(DISTINCT cond) > 1",
    "split_matrix": f"""{fx.with_tables("trials")}, f AS (SELECT trial, (row_number() OVER (ORDER BY trial) - 1) % 5 AS fold FROM trials)
        SELECT CAST(k AS INTEGER) AS fold, trial, CAST(fold = k AS INTEGER) AS in_test FROM f, range(0, 5) r(k)""",
    "bad_splits": f"""{fx.with_tables("trials")}, f AS (SELECT (row_number() OVER (ORDER BY trial) - 1) % 7 AS fold FROM trials), n AS (SELECT count(*) AS total FROM trials)
        SELECT CAST(k AS INTEGER) AS fold, coalesce(c, 0) AS test FROM range(0, 12) r(k) LEFT JOIN (SELECT fold, count(*) AS c FROM f GROUP BY fold) ON fold = k, n WHERE coalesce(c, 0) IN (0, total)""",
    "minmax_scale": f"""{fx.with_tables("weights")} SELECT fold, "window", pixel, round(coalesce((w - min(w) OVER p) / nullif(max(w) OVER p - min(w) OVER p, 0), 0), 6) AS scaled FROM weights WINDOW p AS (PARTITION BY "window")""",
    "factorise": f"{fx.with_tables('sparse')} SELECT session, count(*) AS cells, CAST(dense_rank() OVER (ORDER BY session) - 1 AS INTEGER) AS code FROM sparse GROUP BY session",
}
QUERIES = {
    k: v
    for k, v in globals().items()
    if k in ORACLES or k == "fold_assign_greedy"
}
