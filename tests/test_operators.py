"""Closed-form and published values of the operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.functions.columns import samples
from epochlake.operators import features, metrics, models, resample, select, shape, spatial, spectral, store, targets, wavelets


def signal(spark, values, **more):
    rows = [(1, "c0", i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "epoch_id long, channel string, t_idx int, x double")


def test_published_local_patterns(spark):
    codes = lambda v, k: features.pattern_codes(signal(spark, v), 8, k, "epoch_id").first()["code"]
    assert codes([50, 35, 32, 18, 10, 3, 4, 8, 12], "lndp") == 7
    assert codes([50, 35, 32, 18, 10, 3, -1, -5, -6], "lgp") == 224
    assert codes(range(9), "lbp") == 15


def test_ramp(spark):
    r = features.time_features(signal(spark, [-2, -1, 0, 1, 2]), "epoch_id").first()
    want = {"variance": 2, "rms": math.sqrt(2), "mad": 1, "peak_to_peak": 4, "kurtosis": -1.3, "line_length": 1, "zero_crossing_rate": 0.25, "mobility": 0, "complexity": 0}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-12), k


def test_constant(spark):
    r = features.time_features(signal(spark, [2] * 5), "epoch_id").first()
    assert (r["mean"], r["rms"], r["median"]) == (2, 2, 2)
    assert all(r[k] == 0 for k in ("variance", "std", "mad", "peak_to_peak", "skewness", "kurtosis", "line_length", "zero_crossing_rate", "mobility", "complexity"))


def test_histogram_holds_all_codes(spark):
    h = features.code_histogram(features.pattern_codes(signal(spark, range(20)), 4, "lbp", "epoch_id"), 4, "epoch_id").collect()
    assert len(h) == 16 and sum(r["value"] for r in h) == pytest.approx(1)


def test_tone_has_its_power(spark):
    n, fs = 256, 64
    x = 2 * np.sin(2 * np.pi * 10 * np.arange(n) / fs)
    p = spectral.periodogram(signal(spark, x), n, fs, "epoch_id").collect()
    assert sum(r["power"] for r in p) * fs / n == pytest.approx(2.0, rel=1e-6)
    assert max(p, key=lambda r: r["power"])["freq"] == 10


def test_odd_length_doubles_the_last_bin(spark):
    x = np.random.default_rng(1).standard_normal(15)
    p = {r["k"]: r["power"] for r in spectral.periodogram(signal(spark, x), 15, 1, "epoch_id").collect()}
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(15) / 15)
    f = np.abs(np.fft.rfft(x * w)) ** 2 / (w**2).sum()
    f[1:] *= 2
    assert [p[k] for k in range(8)] == pytest.approx(f.tolist())


def test_windows_layout(spark):
    w = shape.windows(signal(spark, range(1875)), 1875, 500, 250).groupBy("win").agg(F.min("t_idx").alias("a"), F.max("t_idx").alias("b"), F.count("*").alias("n")).orderBy("win").collect()
    assert [(r["a"], r["b"] + 1, r["n"]) for r in w] == [(250 * k, 250 * k + 500, 500) for k in range(6)]


def test_samples_must_be_whole():
    assert samples(0.5, 64) == 32
    with pytest.raises(ValueError):
        samples(0.3, 64)


def test_resampled_tone_keeps_its_frequency(spark):
    x = np.sin(2 * np.pi * 4 * np.arange(512) / 128)
    out = shape.resample(signal(spark, x), 512, 128, 64).orderBy("t_idx").collect()
    y = np.array([r["x"] for r in out])
    assert len(y) == 256 and np.abs(y[40:-40] - np.sin(2 * np.pi * 4 * np.arange(256) / 64)[40:-40]).max() < 0.01


def test_log_covariance_inverts(spark):
    rng = np.random.default_rng(3)
    rows = [(1, c, t, float(v)) for c in range(3) for t, v in enumerate(rng.standard_normal(40))]
    sig = spark.createDataFrame(rows, "epoch_id long, ch_idx int, t_idx int, x double")
    cov = spatial.covariance(sig, 3, 40, "epoch_id")
    mat = lambda df: np.array([r["value"] for r in df.orderBy("i", "j").collect()]).reshape(3, 3)
    c, log = mat(cov), mat(spatial.log_covariance(cov, 3, "epoch_id"))
    v, u = np.linalg.eigh(log)
    assert (u * np.exp(v)) @ u.T == pytest.approx(c)
    t = mat(spatial.tangent_space(cov, 3, F.lit(True), "epoch_id"))
    assert np.abs(t).max() < 1e-8


def test_wavelet_peaks_at_its_tone(spark):
    x = np.sin(2 * np.pi * 20 * np.arange(640) / 128)
    for power in (wavelets.morlet_power(signal(spark, x), 128, [12.0, 20.0, 28.0], "epoch_id"), wavelets.superlet_power(signal(spark, x), 128, [12.0, 20.0, 28.0], (1.0, 4.0), "epoch_id")):
        mean = {r["freq"]: r["p"] for r in power.groupBy("freq").agg(F.avg("power").alias("p")).collect()}
        assert max(mean, key=mean.get) == 20.0


def test_subject_split_is_the_published_one(spark):
    df = spark.createDataFrame([(s,) for s in range(1, 35) if s != 22], "subject long")
    out = targets.group_shuffle_split(df, "subject", 0.2, 42)
    assert sorted(r[0] for r in out.where("side = 'test'").collect()) == [9, 10, 16, 18, 20, 28, 33]


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"s{k % 9}", "t", k % 2, k) for k in range(90)], "subject string, task string, y int, key long")
    out = targets.stratified_group_kfold(df, "subject", 3, 1)
    assert out.count() == 90 and out.groupBy("subject").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert targets.group_kfold(df, "subject", 4, 1).select("fold").distinct().count() == 4


def test_hand_computed_metrics(spark):
    y, p = [[1, 0], [1, 1], [0, 0], [0, 1]], [[1, 1], [0, 1], [0, 1], [0, 1]]
    rows = [(k, f"t{t}", y[k][t], p[k][t], float(p[k][t])) for k in range(4) for t in range(2)]
    df = spark.createDataFrame(rows, "key long, task string, y int, pred int, score double").withColumn("all", F.lit(1))
    ba = {r["task"]: r["balanced_accuracy"] for r in metrics.task_metrics(df, "task").collect()}
    assert ba == {"t0": 0.75, "t1": 0.5}
    s = metrics.sample_metrics(df, "key", "all").first()
    assert (s["bit_accuracy"], s["hamming_loss"], s["micro_iou"]) == (0.625, 0.375, 0.5)


def test_auc_and_precision_with_ties(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.2)], "y int, score double").withColumn("all", F.lit(1))
    assert metrics.roc_auc(df, "all").first()["roc_auc"] == pytest.approx(0.625)
    assert metrics.average_precision(df, "all").first()["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_bootstrap_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{k % 6}", "t", int(rng.integers(2)), int(rng.integers(2))) for k in range(60)]
    df = spark.createDataFrame(rows, "subject string, task string, y int, pred int")
    groups = [f"s{k}" for k in range(6)]
    reps = {r["rep"]: r["value"] for r in resample.bootstrap(metrics.confusion(df, "subject", "task"), resample.draws(spark, groups, 20, 42)).collect()}
    again = np.random.default_rng(42)
    for rep in range(20):
        own = [r for g in again.choice(6, 6) for r in rows if r[0] == f"s{g}"]
        y, p = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        if 0 < y.sum() < len(y):
            assert reps[rep] == pytest.approx(((p[y == 1] == 1).mean() + (p[y == 0] == 0).mean()) / 2)
        else:
            assert rep not in reps


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double").withColumn("all", F.lit(1))
    assert {r["n"]: round(r["adjusted"], 6) for r in resample.holm(df, "p", ("n",), "all").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_selector_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("t", f, 1.0) for f in ("c", "a", "b")], "task string, feature string, f double")
    assert [r["feature"] for r in select.multi_target_best(df, 2).orderBy("rank").collect()] == ["a", "b"]


def test_ridge_and_pls_recover_weights(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3))
    rows = [(*map(float, v), float(v @ [1.0, -2.0, 0.5] + 3)) for v in x]
    df = spark.createDataFrame(rows, "x1 double, x2 double, x3 double, y double")
    for fitted in (models.fit_ridge(df, ["x1", "x2", "x3"], ["y"], 1e-9), models.fit_pls(df, ["x1", "x2", "x3"], ["y"], 3)):
        w = {r["feature"]: r["weight"] for r in fitted.collect()}
        assert [w[k] for k in ("x1", "x2", "x3", "(intercept)")] == pytest.approx([1.0, -2.0, 0.5, 3.0], abs=1e-6)


def test_epoch_index_reads_label_files(spark, tmp_path):
    for s, t in ((2, 1), (1, 1)):
        d = tmp_path / f"S_{s}" / f"Trial_{t}"
        d.mkdir(parents=True)
        (d / "labels.json").write_text(json.dumps({"blocks": [{"Exec_Block_Index": k, "type": "random", "seed": k, "img": [[0, 1]]} for k in (2, 1)]}))
    rows = store.epoch_index(spark, str(tmp_path), "exec").collect()
    assert [(r["subject_id"], r["block_index"]) for r in rows] == [(1, 1), (1, 2), (2, 1), (2, 2)] and rows[0]["eeg_file"] == "exec_EEG_1.fif"


def test_store_refuses_repeats(spark, tmp_path):
    s = spark.createDataFrame([("a", 1)], "run_id string, key long")
    store.append_scores(s, str(tmp_path / "scores"))
    with pytest.raises(ValueError):
        store.append_scores(s, str(tmp_path / "scores"))
    assert store.run_state(s, spark.read.parquet(str(tmp_path / "scores"))) == "reuse"
    files = store.file_table(spark, str(tmp_path / "scores"))
    assert store.disagreements(files, files).isEmpty()
    assert store.materialize(s, str(tmp_path / "m"), {"v": 1}).count() == 1 == store.materialize(s, str(tmp_path / "m"), {"v": 1}).count()


def test_unknown_blocks_are_an_error(spark):
    f = spark.createDataFrame([(1, "time", "mean", 0, 1.0)], "epoch_id long, block string, feature string, ordinal int, value double")
    with pytest.raises(ValueError):
        features.select_blocks(f, ["time", "space"])
    dup = f.unionByName(f)
    with pytest.raises(ValueError):
        targets.align(dup, f, "epoch_id")
