"""Array files, the cube store, run records."""

import io
import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.operators import folds, normalize, weights
from trialframe.sources import recordings, runs


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def mat_file(arrays, packed):
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in arrays.items():
        name = name.encode()
        short = struct.pack("<HH", 1, len(name)) + name.ljust(4, b"\0") if len(name) <= 4 else element(1, name)
        body = element(6, struct.pack("<II", 7, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + short + element(7, a.astype("<f4").tobytes(order="F"))
        one = element(14, body)
        out += struct.pack("<II", 15, len(z := zlib.compress(one))) + z if packed else one
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_mat_and_npy_cubes_agree(spark, tmp_path, packed):
    rng = np.random.default_rng(1)
    arrays = {"cond2": rng.standard_normal((3, 4, 2)).astype("f4"), "cond10": rng.standard_normal((2, 2, 1)).astype("f4"), "x": np.zeros((1, 1), "f4")}
    (tmp_path / "conds_990131k.mat").write_bytes(mat_file(arrays, packed))
    for k in (2, 10):
        np.save(tmp_path / f"conds{k}_990131k.npy", arrays[f"cond{k}"])
    mat, npy = recordings.read_mat_cubes(spark, str(tmp_path)), recordings.read_npy_cubes(spark, str(tmp_path))
    assert sorted(mat.collect()) == sorted(npy.collect())
    r = mat.where("cond = 2 and pixel = 1 and frame = 3 and trial = 1").first()
    assert r.value == pytest.approx(float(arrays["cond2"][1, 3, 1]))


def test_mask(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.array([0, 1, 1, 0]))
    assert [r.pixel for r in recordings.read_npy_mask(spark, str(tmp_path / "m.npy")).collect()] == [1, 2]
    buf = io.BytesIO()
    np.save(buf, np.zeros((2, 2)))
    (tmp_path / "conds1_s.npy").write_bytes(buf.getvalue())
    with pytest.raises(Exception, match="3 axes"):
        recordings.read_npy_cubes(spark, str(tmp_path)).collect()


def test_cube_store(spark, tmp_path):
    cube = spark.range(20).select(F.lit("a").alias("session"), (F.col("id") % 2).cast("int").alias("cond"), F.lit(0).alias("trial"), F.col("id").cast("int").alias("frame"), F.lit(0).alias("pixel"), F.rand(1).alias("value"))
    recordings.write_cube(cube, f"{tmp_path}/c")
    with pytest.raises(Exception, match="(?i)exists"):
        recordings.write_cube(cube, f"{tmp_path}/c")
    recordings.write_cube(cube, f"{tmp_path}/c", overwrite=True)
    assert recordings.read_cube(spark, f"{tmp_path}/c").where("cond = 1").count() == 10


def test_runs(spark, tmp_path):
    df = spark.range(3)
    runs.save_run({"folds": df}, {"experiment": "x", "window": [1, 2], "n_splits": 5}, str(tmp_path), "r1")
    assert runs.load_run(spark, str(tmp_path), "r1", "folds").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        runs.save_run({"folds": df}, {}, str(tmp_path), "r1")
    row = runs.list_runs(spark, str(tmp_path)).first()
    assert (row.run_id, row.config.experiment, row.config.window, row.config.n_splits, row.config.model) == ("r1", "x", [1, 2], 5, None)


def test_names_and_permutation_schemas(spark):
    names = spark.createDataFrame([("sliding_window__990131k24_frame1-100",), ("plain",)], "name string")
    assert [tuple(r)[1:] for r in runs.parse_run_names(names).collect()] == [("990131", "k", "2,4"), ("", "", "")]
    old = runs.unified_permutations(spark.createDataFrame([(0, 0.5)], "perm int, shuffled_scores double")).first()
    assert (old.trial_score, old.frame_score) == (0.5, None)


def test_run_names_with_times(spark):
    when = datetime(2031, 5, 6, 7, 8, 9)
    assert runs.run_id("x", "t", when) == "x__t____2031-05-06_07-08-09"
    row = spark.createDataFrame([(when, "plain")], "t timestamp, n string").select(runs.suffixed(F.lit("x__t"), F.col("t")).alias("name"), "n")
    got = row.select("name", runs.run_time(F.col("name")).alias("at"), runs.run_time(F.col("n")).alias("none")).first()
    assert (got.name, got.at, got.none) == ("x__t____2031-05-06_07-08-09", when, None)


def test_stored_records_of_either_schema(spark, tmp_path):
    """Archives under the stored names, made by hand, and the same kinds of run in the store, each in one scan."""
    new = {
        "shuffled_scores_trials": [0.4, 0.6], "shuffled_scores_frames": [0.45, 0.55], "real_trial_acc": 0.9, "real_trial_std": 0.1, "real_frame_acc": 0.8, "real_frame_std": 0.2,
        "shuffled_trial_mean": 0.5, "shuffled_trial_std": 0.14, "shuffled_trial_min": 0.4, "shuffled_trial_max": 0.6, "p_value_trial_two_tailed": 1 / 3, "pass_alpha_0p05_trial": False,
    }
    old = {"shuffled_scores": [0.3], "real_score": 0.7, "real_std": 0.05, "shuffled_mean": 0.3, "shuffled_std": 0.0, "shuffled_min": 0.3, "shuffled_max": 0.3, "p_value": 0.01, "pass_alpha_0p05": True}
    sliding = {
        "centers": [3, 4], "real_trial_curve": [0.5, 0.9], "real_fold_trial_acc": [[0.4, 0.6], [0.8, 1.0]], "real_frame_curve": np.nan, "null_trial_acc": [[0.5, 0.4], [0.6, 0.5], [0.4, 0.6]],
        "null_frame_acc": [[0.5, 0.5]] * 3, "null_trial_folds": [[[0.5], [0.4]], [[0.6], [0.5]], [[0.4], [0.6]]], "null_trial_mean": [0.5, 0.5], "null_trial_std": [0.1, 0.1],
        "null_frame_mean": [0.5, 0.5], "null_frame_std": [0.0, 0.0],
    }
    for name, record in (("new", new), ("old", old), ("sliding", sliding)):
        (tmp_path / name).mkdir()
        np.savez_compressed(tmp_path / name / "perm_result.npz", **{k: np.asarray(v) for k, v in record.items()})
    rows = {r.run_id: r for r in runs.read_stored_records(spark, f"{tmp_path}/*/perm_result.npz").collect()}
    assert all(rows["new"][k] == (v if not isinstance(v, float) else pytest.approx(v)) for k, v in new.items())
    assert [rows["old"][k] for k in runs.SUMMARY] == [0.7, 0.05, 0.3, 0.0, 0.3, 0.3, 0.01, True, None, None]
    assert rows["old"].shuffled_scores_trials == [0.3] and rows["old"].shuffled_scores_frames is None and rows["old"].centers is None
    assert rows["sliding"].real_frame_curve is None and rows["sliding"].real_fold_trial_acc == sliding["real_fold_trial_acc"] and rows["sliding"].real_trial_acc is None
    record = runs.read_stored_records(spark, f"{tmp_path}/sliding/perm_result.npz")
    assert [tuple(r)[1:] for r in runs.sliding_curves(record).orderBy("window").collect()] == [(0, 3, 0.5, None, 0.5, 0.1, 0.5, 0.0), (1, 4, 0.9, None, 0.5, 0.1, 0.5, 0.0)]
    assert runs.sliding_null(record).count() == 6 and runs.sliding_null(record).where("perm = 2 and center = 4").first().trial_acc == 0.6
    store = f"{tmp_path}/store"
    runs.save_permutations(spark.createDataFrame([(new["shuffled_scores_trials"], 0.9)], "shuffled_scores_trials array<double>, real_trial_acc double"), {"n_permutations": 2}, store, "a")
    runs.save_permutations(spark.createDataFrame([(old["shuffled_scores"], 0.7)], "shuffled_scores array<double>, real_score double"), {}, store, "b")
    both = {r.run_id: r for r in runs.load_permutations(spark, store).collect()}
    assert (both["a"].shuffled_scores_trials, both["a"].real_trial_acc, both["b"].shuffled_scores_trials, both["b"].real_trial_acc) == ([0.4, 0.6], 0.9, [0.3], 0.7)


def test_run_store(spark, tmp_path):
    root, df = f"{tmp_path}/runs", spark.range(2)
    when = datetime(2031, 5, 6, 7, 8, 9)
    run = runs.save_experiment({"folds": df}, {"n_splits": 5}, root, "sliding_window", "990131k24_x", "/data/roi.npy", when)
    assert run == "sliding_window__990131k24_x____2031-05-06_07-08-09"
    with pytest.raises(FileExistsError):
        runs.save_experiment({"folds": df}, {}, root, "sliding_window", "990131k24_x", "/data/roi.npy", when)
    runs.claim(spark, root, "half")
    df.write.parquet(f"{root}/half/folds")  # a run that broke off before its manifest
    row = runs.list_runs(spark, root).collect()
    assert [(r.run_id, r.roi_mask_path, r.tables, r.config.experiment, r.config.n_splits) for r in row] == [(run, "/data/roi.npy", ["folds"], "sliding_window", 5)]
    assert {r.run_id for r in runs.load_all(spark, root, "folds").collect()} == {run}
    assert runs.permutation_run_id("m", 100, 42, "t") == "m__permutation__perm100__seed42__t" and runs.permutation_run_id(None, 9, 1, "t") == "slidingwindow__perm9__seed1__t"
    with pytest.raises(FileNotFoundError):
        runs.load_sliding_permutations(spark, root, run)
    runs.export_runs(runs.load_all(spark, root, "folds"), f"{tmp_path}/out")
    assert {tuple(r) for r in spark.read.json(f"{tmp_path}/out").select("run_id", "date", "session", "conditions").collect()} == {(run, "990131", "k", "2,4")}
    with pytest.raises(ValueError):
        runs.export_runs(df, f"{tmp_path}/out2", "mat")


def test_dataset_of_a_configuration(spark):
    rows = [(s, c, t, f, p, float(c + t + f * p)) for s in "kl" for c in (1, 2) for t in range(2 + c) for f in range(4) for p in range(2)]
    cube = spark.createDataFrame(rows, "session string, cond int, trial int, frame int, pixel int, value double")
    config = {"face_file": "conds1_k.npy", "nonface_file": "conds2_k.npy", "baseline_frames": [0, 2]}
    got = runs.dataset_of(config, cube)
    assert {(r.trial, r.y) for r in got.select("trial", "y").distinct().collect()} == {(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)}
    with pytest.raises(ValueError):
        runs.dataset_of({**config, "nonface_file": "conds2_l.npy"}, cube)


def test_validation(spark):
    cube = spark.createDataFrame([("b", 1, 0, 0, 0, 2.0)], "session string, cond int, trial int, frame int, pixel int, value double")
    with pytest.raises(ValueError, match="blank"):
        normalize.blank(cube, 3, strict=True)
    with pytest.raises(ValueError, match="mask"):
        weights.sign_timecourse(cube, spark.createDataFrame([(0, True, False)], "pixel int, pos_mask boolean, neg_mask boolean"), strict=True)
    x = spark.createDataFrame([(0, 1), (0, 0)], "trial int, y int")
    with pytest.raises(ValueError, match="differ"):
        folds.require_labels(x, x.limit(1))
    with pytest.raises(ValueError, match="match"):
        folds.require_labels(x.limit(1), spark.createDataFrame([(1, 1)], "trial int, y int"))


def test_array_files_split_into_byte_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    arrays = {("k", 1): rng.standard_normal((7, 5, 3)), ("k", 2): np.asfortranarray(rng.standard_normal((4, 6, 5)).astype("f4")), ("l", 1): rng.integers(0, 9, (3, 2, 2)), ("l", 30): np.zeros((0, 2, 2))}
    (tmp_path / "deep").mkdir()
    for (s, c), a in arrays.items():
        np.save(tmp_path / ("deep" if s == "l" else ".") / f"condsXY{c}_{s}.npy", a)
    want = sorted((s, c, t, f, p, float(np.float32(a[p, f, t]))) for (s, c), a in arrays.items() for p, f, t in np.ndindex(a.shape))
    for size in (None, 8, 53, 10**9):  # ranges may lie in the header and cut values in two
        got = recordings.read_npy_cubes(spark, str(tmp_path), size)
        assert sorted(map(tuple, got.collect())) == want
    small = recordings.read_npy_cubes(spark, str(tmp_path), 100)
    assert small.rdd.getNumPartitions() > 10
    one = small.where("session = 'k' and cond in (2, 7) and frame > 3")
    assert sorted(map(tuple, one.collect())) == [r for r in want if r[0] == "k" and r[1] == 2 and r[3] > 3]
    assert one.rdd.getNumPartitions() < small.rdd.getNumPartitions() / 2
    assert small.where("session = 'nobody'").count() == 0
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters" in plan or one.rdd.getNumPartitions() == -(-(tmp_path / "condsXY2_k.npy").stat().st_size // 100)


@pytest.mark.parametrize("packed", [False, True])
def test_mat_variables_are_dealt_to_tasks(spark, tmp_path, packed, monkeypatch):
    rng = np.random.default_rng(4)
    arrays = {f"cond{k}": rng.standard_normal((k, 3, 4)).astype("f4") for k in range(1, 9)}
    (tmp_path / "conds_a.mat").write_bytes(mat_file(arrays, packed))
    got = recordings.read_mat_cubes(spark, str(tmp_path), 200)
    assert got.rdd.getNumPartitions() > 4
    want = sorted(("a", k, t, f, p, float(arrays[f"cond{k}"][p, f, t])) for k in range(1, 9) for p in range(k) for f in range(3) for t in range(4))
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, got.where("cond = 5").collect())) == [r for r in want if r[1] == 5]


def test_broken_array_files(spark, tmp_path):
    np.save(tmp_path / "conds1_a.npy", np.zeros((2, 3, 4)))
    whole = (tmp_path / "conds1_a.npy").read_bytes()
    (tmp_path / "conds1_a.npy").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends before"):
        recordings.read_npy_cubes(spark, str(tmp_path)).collect()
    np.save(tmp_path / "conds1_a.npy", np.zeros((2, 3, 4), complex))
    with pytest.raises(Exception, match="no real number"):
        recordings.read_npy_cubes(spark, str(tmp_path)).collect()
    (tmp_path / "conds_b.mat").write_bytes(mat_file({"cond1": np.zeros((2, 3, 4), "f4")}, True)[:-20])
    with pytest.raises(Exception):
        recordings.read_mat_cubes(spark, str(tmp_path)).collect()


def test_cube_store_skips_what_exists(spark, tmp_path):
    cube = spark.createDataFrame([("a", 1, 0, 0, 0, 2.0)], "session string, cond int, trial int, frame int, pixel int, value double")
    recordings.write_cube(cube, f"{tmp_path}/c", skip_existing=True)
    recordings.write_cube(cube.withColumn("value", F.lit(3.0)), f"{tmp_path}/c", skip_existing=True)
    assert recordings.read_cube(spark, f"{tmp_path}/c").first().value == 2.0
    with pytest.raises(ValueError):
        recordings.write_cube(cube, f"{tmp_path}/c", overwrite=True, skip_existing=True)


def test_datasets_of_many_configurations(spark):
    rows = [(s, c, t, f, p, float((3 * c + t * t + f * p) % 7)) for s in "kl" for c in (1, 2, 3) for t in range(2 + c) for f in range(6) for p in range(2)]
    cube = spark.createDataFrame(rows, "session string, cond int, trial int, frame int, pixel int, value double")
    texts = {"r1": {"face_file": "conds1_k.npy", "nonface_file": "conds2_k.npy", "baseline_frames": [0, 2]}, "r2": {"face_file": "condsXY3_k", "nonface_file": "conds1_k.npy", "zscore_baseline_frames": [1, 2, 3, 4]}, "r3": {"face_file": "conds2_l.npy", "nonface_file": "conds3_l.npy", "baseline_frames": [0, 3]}}
    configs = runs.parse_configs(spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "run_id string, json string"))
    columns = ["session", "cond", "trial", "y", "frame", "pixel", "value", "mu", "sd", "z"]
    got = runs.datasets_of(configs, cube)
    for k, config in texts.items():
        rounded = lambda df: sorted(df.select([F.round(c, 9) if c in ("mu", "sd", "z") else c for c in columns]).collect())
        assert rounded(got.where(F.col("run_id") == k)) == rounded(runs.dataset_of(config, cube))
    for wrong in ({"nonface_file": "conds2_l.npy"}, {"baseline_frames": None}, {"nonface_file": "conds1_k.npy"}, {"face_file": None}):
        bad = runs.parse_configs(spark.createDataFrame([("r9", json.dumps(texts["r1"] | wrong))], "run_id string, json string"))
        with pytest.raises(Exception, match="no two conditions"):
            runs.datasets_of(bad, cube).collect()
    assert runs.datasets_of(configs.where("run_id = 'none'"), cube).count() == 0


def test_lineitem_is_read_once_for_a_data_set(spark):
    """The cube of the data set is made once: what follows reads its cells, not lineitem again."""
    from trialframe.plans import preprocessing

    rows = preprocessing.dataset_from_config(spark, "/root/testdata/sf0.001")
    assert "l_extendedprice" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count()
