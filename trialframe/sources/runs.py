"""Run records: names, catalogs, configurations and results as Parquet tables."""

from __future__ import annotations

import io
import json
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import significance, validation

#: The session token of run names, the form of their time suffix, and the keys of configurations.
TOKEN = r"_(\d+)([A-Za-z])(\d+)_"
SUFFIX, SUFFIX_FORM = r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})$", "yyyy-MM-dd_HH-mm-ss"
CONFIG = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("experiment", "tag", "face_file", "nonface_file", "data_dir", "metric", "rule", "tie_break", "outer_cv", "inner_cv", "model", "estimator", "source_run_dir", "source_model_name", "level")]
    + [T.StructField(k, T.LongType()) for k in ("n_trials_per_class", "random_state", "window_size", "start_frame", "stop_frame", "step", "n_splits", "n_permutations", "perm_seed", "svm_random_state")]
    + [T.StructField(k, T.ArrayType(T.LongType())) for k in ("window", "zscore_baseline_frames", "baseline_frames")]
    + [T.StructField("C_grid", T.ArrayType(T.DoubleType()))]
)


def parse_run_names(names: DataFrame) -> DataFrame:
    """name, date, session, conditions (digits joined by commas); empty where there is no session token."""
    part = lambda k: F.regexp_extract("name", TOKEN, k)
    return names.select("name", part(1).alias("date"), part(2).alias("session"), F.array_join(F.filter(F.split(part(3), ""), lambda c: c != ""), ",").alias("conditions"))


def file_catalog(files: DataFrame) -> DataFrame:
    """session, cond, path of cube files conds<cond>_<session>.npy."""
    stem = F.regexp_extract("path", r"([^/\\]+)\.npy$", 1)
    return files.select(F.regexp_extract(stem, r"^conds[A-Za-z]*(\d+)_(.+)$", 2).alias("session"), F.regexp_extract(stem, r"^conds[A-Za-z]*(\d+)_(.+)$", 1).cast("int").alias("cond"), "path")


def suffixed(name: Column, when: Column) -> Column:
    """A run name with its time suffix."""
    return F.concat(name, F.lit("____"), F.date_format(when, SUFFIX_FORM))


def run_time(name: Column) -> Column:
    """The time in a run name's suffix; null where there is none."""
    return F.try_to_timestamp(F.regexp_extract(name, SUFFIX, 1), F.lit(SUFFIX_FORM))


#: Names under which records of fixed permutation runs store their numbers; second the older name, if it has one.
SUMMARY = {
    "real_trial_acc": ("double", "real_score"), "real_trial_std": ("double", "real_std"), "shuffled_trial_mean": ("double", "shuffled_mean"),
    "shuffled_trial_std": ("double", "shuffled_std"), "shuffled_trial_min": ("double", "shuffled_min"), "shuffled_trial_max": ("double", "shuffled_max"),
    "p_value_trial_two_tailed": ("double", "p_value"), "pass_alpha_0p05_trial": ("boolean", "pass_alpha_0p05"),
    "real_frame_acc": ("double", None), "real_frame_std": ("double", None),
}
SCORES = {"shuffled_scores_trials": ("array<double>", "shuffled_scores"), "shuffled_scores_frames": ("array<double>", None)}
#: Names of the arrays of sliding permutation records.
SLIDING = {
    "centers": "array<int>", "real_trial_curve": "array<double>", "real_fold_trial_acc": "array<array<double>>", "real_frame_curve": "array<double>",
    "null_trial_acc": "array<array<double>>", "null_frame_acc": "array<array<double>>", "null_trial_folds": "array<array<array<double>>>",
    "null_trial_mean": "array<double>", "null_trial_std": "array<double>", "null_frame_mean": "array<double>", "null_frame_std": "array<double>",
}


def _unified(rows: DataFrame, names: dict) -> list[Column]:
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return [F.coalesce(have(new), have(old)).cast(kind).alias(new) for new, (kind, old) in names.items()]


def unified_summary(rows: DataFrame) -> DataFrame:
    """The summary numbers of permutation records of either schema under the newer names; missing ones are null."""
    return rows.select(*[c for c in ("run_id",) if c in rows.columns], *_unified(rows, SUMMARY))


def unified_permutations(rows: DataFrame) -> DataFrame:
    """perm, trial_score, frame_score of either schema; old records have no frame scores."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    return rows.select("perm", F.coalesce(have("shuffled_scores_trials"), have("shuffled_scores")).alias("trial_score"), have("shuffled_scores_frames").alias("frame_score"))


def parse_configs(texts: DataFrame) -> DataFrame:
    """configurations (column json) as a struct `config` of all known keys."""
    return texts.withColumn("config", F.from_json("json", CONFIG))


def run_id(experiment: str, tag: str, when: str | datetime) -> str:
    return f"{experiment}__{tag}____{_stamp(when)}"


def permutation_run_id(source: str | None, n: int, seed: int, when: str | datetime) -> str:
    """The name of a permutation run: of a fixed window it begins with its model's, of sliding windows (source None) not."""
    return f"{'slidingwindow' if source is None else source + '__permutation'}__perm{n}__seed{seed}__{_stamp(when)}"


def _stamp(when: str | datetime) -> str:
    return when if isinstance(when, str) else when.strftime("%Y-%m-%d_%H-%M-%S")


def claim(spark: SparkSession, root: str, run: str) -> None:
    """Take a run's name for one writer: its marker file is created, or there is one and this is an error.

    The file system creates a file for one of several callers; the others get an error too.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{run}/_claimed")
    try:
        taken = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(where)
    except Exception as error:
        raise FileExistsError(f"run {run} exists: {error}") from error
    if not taken:
        raise FileExistsError(f"run {run} exists")


def save_run(tables: dict[str, DataFrame], config: dict, root: str, run: str, roi_mask_path: str | None = None, rules: dict[str, dict[str, Column]] | None = None) -> None:
    """Write the result tables of a run, then its manifest: configuration, path of the region, names of the tables.

    Of several writers of one name one goes on, the others fail before they write. The manifest comes last, so a run
    that broke off is not listed; its name stays taken. rules of a table (see validation) are checked as it is
    written; a run that breaks one raises and gets no manifest.
    """
    if unknown := set(rules or {}) - set(tables):
        raise ValueError(f"rules for tables that are not there: {sorted(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    claim(spark, root, run)
    for name, df in tables.items():
        rows, verify = validation.observed(df, (rules or {}).get(name, {}))
        rows.write.mode("errorifexists").parquet(f"{root}/{run}/{name}")
        verify()
    row = spark.createDataFrame([(run, json.dumps(config, default=str), roi_mask_path, sorted(tables))], "run_id string, json string, roi_mask_path string, tables array<string>")
    row.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{run}/config")


def save_experiment(tables: dict[str, DataFrame], info: dict, root: str, experiment: str, tag: str, roi_mask_path: str, when: str | datetime | None = None) -> str:
    """save_run under the name made of experiment, tag and time, which are kept in the configuration; returns the name."""
    run = run_id(experiment, tag, when or datetime.now())
    save_run(tables, {"experiment": experiment, "tag": tag} | info, root, run, roi_mask_path)
    return run


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def fixed_permutation_record(null: DataFrame, real: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The one-row record of a fixed permutation run, under the stored names.

    null(perm, fold, frame_acc, trial_acc) as fixed_permutations gives it, real as nested_summary does. Scores are means over
    folds in the order of perm; as many numbers as permutations.
    """
    score = null.groupBy("perm").agg(F.avg("trial_acc").alias("t"), F.avg("frame_acc").alias("f"))
    real = real.select(F.col("acc_trial_mean").alias("rt"), F.col("acc_trial_std").alias("rts"), F.col("acc_mean").alias("rf"), F.col("acc_std").alias("rfs"))
    listed = F.array_sort(F.collect_list(F.struct("perm", "t", "f")))
    once = [F.max(c).alias(k) for k, c in (("real_trial_acc", "rt"), ("real_trial_std", "rts"), ("real_frame_acc", "rf"), ("real_frame_std", "rfs"))]
    out = score.crossJoin(F.broadcast(real)).agg(
        listed.alias("l"), *once, F.avg("t").alias("shuffled_trial_mean"), F.stddev_samp("t").alias("shuffled_trial_std"), F.min("t").alias("shuffled_trial_min"),
        F.max("t").alias("shuffled_trial_max"), significance.p_value(F.col("t"), F.col("rt"), "two").alias("p_value_trial_two_tailed"),
    )
    out = out.withColumn("pass_alpha_0p05_trial", F.col("p_value_trial_two_tailed") < alpha)
    return out.select(F.col("l.t").alias("shuffled_scores_trials"), F.col("l.f").alias("shuffled_scores_frames"), *SUMMARY)


def sliding_permutation_record(null: DataFrame, centers: DataFrame, curve: DataFrame | None = None, folds: DataFrame | None = None) -> DataFrame:
    """The one-row record of a sliding permutation run, under the stored names.

    null(perm, window, fold, frame_acc, trial_acc); centers(window, center); curve(window, trial_acc, frame_acc) and
    folds(window, fold, trial_acc) of the real run, null in the record if it has none. Deviations of the null are population ones.
    """
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    by_window = null.groupBy("perm", "window").agg(F.avg("trial_acc").alias("t"), F.avg("frame_acc").alias("f"), listed("fold", "trial_acc").alias("k"))
    by_perm = by_window.groupBy("perm").agg(listed("window", "t", "f", F.col("k.trial_acc").alias("k")).alias("w"))
    perms = by_perm.agg(listed("perm", F.col("w.t").alias("t"), F.col("w.f").alias("f"), F.col("w.k").alias("k")).alias("p"))
    band = by_window.groupBy("window").agg(F.avg("t").alias("tm"), F.stddev_pop("t").alias("ts"), F.avg("f").alias("fm"), F.stddev_pop("f").alias("fs"))
    band = band.join(centers.select("window", "center").distinct(), "window").agg(listed("window", "center", "tm", "ts", "fm", "fs").alias("b"))
    out = perms.crossJoin(band)
    values = {
        "centers": F.col("b.center"), "null_trial_acc": F.col("p.t"), "null_frame_acc": F.col("p.f"), "null_trial_folds": F.col("p.k"),
        "null_trial_mean": F.col("b.tm"), "null_trial_std": F.col("b.ts"), "null_frame_mean": F.col("b.fm"), "null_frame_std": F.col("b.fs"),
    }
    if curve is not None:
        out = out.crossJoin(curve.agg(listed("window", "trial_acc", "frame_acc").alias("c")))
        values |= {"real_trial_curve": F.col("c.trial_acc"), "real_frame_curve": F.col("c.frame_acc")}
    if folds is not None:
        per = folds.groupBy("window").agg(listed("fold", "trial_acc").alias("k"))
        out = out.crossJoin(per.agg(listed("window", F.col("k.trial_acc").alias("k")).alias("r")))
        values |= {"real_fold_trial_acc": F.col("r.k")}
    return out.select(*[values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in SLIDING.items()])


def save_permutations(record: DataFrame, config: dict, root: str, run: str) -> None:
    """Write a permutation run: its one-row record as table perm_result."""
    save_run({"perm_result": record}, config, root, run)


def load_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all whole runs in one scan, columns of all of them merged, with run_id."""
    whole = list_runs(spark, root).where(F.array_contains(F.coalesce("tables", F.array(F.lit(name))), name)).select("run_id")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/*/{name}")
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{name}/[^/]+$", 1)
    return rows.withColumn("run_id", F.coalesce(F.try_url_decode(path), path)).join(whole, "run_id", "left_semi")


def load_permutations(spark: SparkSession, root: str) -> DataFrame:
    """The fixed permutation records of all runs, old and new ones under the newer names."""
    rows = load_all(spark, root, "perm_result")
    return rows.select("run_id", *_unified(rows, SCORES), *_unified(rows, SUMMARY))


def load_sliding_permutations(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The record of a sliding permutation run with all arrays of SLIDING, missing ones null; an error if it is missing."""
    if not exists(spark, f"{root}/{run}/perm_result"):
        raise FileNotFoundError(f"{root}/{run}/perm_result")
    rows = spark.read.parquet(f"{root}/{run}/perm_result")
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in SLIDING.items()], F.lit(run).alias("run_id"))


def _or_empty(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with empty arrays for null ones, whose entries then are null beside those of others."""
    return rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in names})


def sliding_curves(records: DataFrame) -> DataFrame:
    """(run_id, window, center, and the curves and null bands at it) of sliding permutation records."""
    names = ["centers", "real_trial_curve", "real_frame_curve", "null_trial_mean", "null_trial_std", "null_frame_mean", "null_frame_std"]
    there = _or_empty(records, names)
    at = there.select("run_id", F.posexplode(F.arrays_zip(*names)).alias("window", "v"))
    return at.select("run_id", "window", F.col("v.centers").alias("center"), *[F.col(f"v.{c}").alias(c) for c in names[1:]])


def sliding_null(records: DataFrame) -> DataFrame:
    """(run_id, perm, window, center, trial_acc, frame_acc) of sliding permutation records, perm counted from 0."""
    names = ["null_trial_acc", "null_frame_acc"]
    perms = _or_empty(records, names).select("run_id", "centers", F.posexplode(F.arrays_zip(*names)).alias("perm", "v"))
    perms = _or_empty(perms.select("run_id", "centers", "perm", *[F.col(f"v.{c}").alias(c) for c in names]), names)
    cells = perms.select("run_id", "perm", F.posexplode(F.arrays_zip("centers", *names)).alias("window", "c"))
    return cells.select("run_id", "perm", "window", F.col("c.centers").alias("center"), F.col("c.null_trial_acc").alias("trial_acc"), F.col("c.null_frame_acc").alias("frame_acc"))


def read_stored_records(spark: SparkSession, pattern: str) -> DataFrame:
    """Permutation records in .npz archives as older tools store them, a row each: run_id (the folder) and all arrays of either kind.

    Numbers outside an archive's schema are null; a scalar where an array belongs (a real curve that was not
    there) is null too. Objects are not unpickled.
    """
    kinds = {k: t for k, (t, _) in (SCORES | SUMMARY).items()} | SLIDING
    older = {old: t for t, old in (SCORES | SUMMARY).values() if old}

    schema = spark.createDataFrame([], "run_id string, " + ", ".join(f"{k} {t}" for k, t in (kinds | older).items())).schema
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                row = {"run_id": path.rstrip("/").split("/")[-2]}
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for k in set(archive.files) & (kinds.keys() | older.keys()):
                        deep, v = (kinds.get(k) or older[k]).startswith("array"), archive[k]
                        row[k] = (v.tolist() if v.ndim else None) if deep else v.item()
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)

    read = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(rows, schema)
    return read.select("run_id", *_unified(read, SCORES), *_unified(read, SUMMARY), *SLIDING)


def export_runs(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write rows with run_id as JSON or Parquet, each with date, session and conditions from the run's name.

    A name without a session token gives empty ones.
    """
    if form not in ("json", "parquet"):
        raise ValueError("form is json or parquet")
    clash = [c for c in ("name", "date", "session", "conditions") if c in rows.columns]
    names = parse_run_names(rows.select(F.col("run_id").alias("name")).distinct())
    rows.drop(*clash).join(names, F.col("run_id") == F.col("name"), "left").drop("name").write.mode("errorifexists").format(form).save(path)


def dataset_of(config: dict, cube: DataFrame) -> DataFrame:
    """The data set of a configuration rebuilt from the cube store: both conditions balanced, labelled, z-scored.

    face_file and nonface_file name session and condition as file_catalog reads them; the baseline is
    the half-open range of the first and last entry of zscore_baseline_frames (or baseline_frames).
    """
    from ..operators import features, normalize

    names = [re.search(r"conds[A-Za-z]*(\d+)_(.+?)(?:\.npy)?$", config[k]) for k in ("face_file", "nonface_file")]
    if not all(names) or names[0][2] != names[1][2]:
        raise ValueError("the configuration does not name two conditions of one session")
    frames = config.get("zscore_baseline_frames") or config.get("baseline_frames")
    one = cube.where(F.col("session") == names[0][2])
    pairs = features.pairwise_dataset(one, int(names[0][1]), int(names[1][1]), ("session",))
    return normalize.zscore_pooled(pairs, (frames[0], frames[-1]), keys=("session",))


def datasets_of(configs: DataFrame, cube: DataFrame) -> DataFrame:
    """The data sets of all configurations (run_id, config) rebuilt in one plan: run_id, the cube's columns, y, mu, sd, z.

    As dataset_of, for any number of runs: configurations are joined to the cube store by session and
    condition, which is scanned as often as for one. A configuration that does not name two conditions of
    one session, or no baseline, is an error while the rows pass. A session of several runs is in each.
    """
    from ..operators import features, normalize

    part = lambda k, i: F.regexp_extract(F.coalesce(f"config.{k}", F.lit("")), r"conds[A-Za-z]*(\d+)_(.+?)(?:\.npy)?$", i)
    frames = F.coalesce("config.zscore_baseline_frames", "config.baseline_frames")
    right = (part("face_file", 2) != "") & (part("face_file", 2) == part("nonface_file", 2)) & (part("face_file", 1) != part("nonface_file", 1)) & (F.size(F.coalesce(frames, F.array().cast("array<long>"))) > 0)
    session = F.when(right, part("face_file", 2)).otherwise(F.raise_error(F.concat(F.lit("no two conditions of one session, or no baseline: "), "run_id")))
    sides = F.array(*[F.struct(part(k, 1).cast("int").alias("cond"), F.lit(y).alias("y")) for k, y in (("face_file", 1), ("nonface_file", 0))])
    named = configs.select("run_id", session.alias("session"), F.element_at(frames, 1).alias("_from"), F.element_at(frames, -1).alias("_to"), F.explode(sides).alias("_side"))
    cells = cube.join(named.select("run_id", "session", "_from", "_to", "_side.cond", "_side.y"), ["session", "cond"])
    pairs = features.balanced_cells(cells, ("run_id",))
    return normalize.zscore_pooled(pairs, (F.col("_from"), F.col("_to")), keys=("run_id",)).drop("_from", "_to")


def load_run(spark: SparkSession, root: str, run: str, name: str) -> DataFrame:
    """A result table of a run; an error if it is missing."""
    return spark.read.parquet(f"{root}/{run}/{name}").withColumn("run_id", F.lit(run))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """run_id, json, roi_mask_path, tables and config of all whole runs; the last two columns are null in older manifests."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/*/config")
    older = [F.lit(None).cast(t).alias(c) for c, t in (("roi_mask_path", "string"), ("tables", "array<string>")) if c not in rows.columns]
    return parse_configs(rows.select("*", *older))
