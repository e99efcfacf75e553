"""Means and filters of matrices, and wavelet powers, against plain numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import spatial, wavelets


def eig_map(m, f):
    values, vectors = np.linalg.eigh(m)
    return vectors * f(values) @ vectors.T


def karcher(ms, rounds=200):
    mean = np.mean(ms, axis=0)
    for _ in range(rounds):
        root, white = eig_map(mean, np.sqrt), eig_map(mean, lambda v: v**-0.5)
        step = np.mean([eig_map(white @ m @ white, np.log) for m in ms], axis=0)
        mean = root @ eig_map(step, np.exp) @ root
    return mean


def signals(spark, scans, n_epochs=30, channels=4, n=40, seed=1):
    """Signals that are counted each time they are made."""
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(n_epochs, channels, channels))
    x = np.einsum("eij,ejt->eit", turn, rng.normal(size=(n_epochs, channels, n)))
    base = spark.createDataFrame([(e, e % 2, x[e].ravel().tolist()) for e in range(n_epochs)], "epoch_id int, y int, v array<double>").repartition(3)

    def made(parts):
        for p in parts:
            scans.add(len(p))
            yield p

    rows = base.mapInPandas(made, base.schema).select("epoch_id", "y", F.posexplode("v").alias("p", "x"))
    return rows.select("epoch_id", "y", F.floor(F.col("p") / n).cast("int").alias("ch_idx"), (F.col("p") % n).alias("t_idx"), "x"), x


def test_mean_from_one_scan_of_the_signal(spark):
    scans = spark.sparkContext.accumulator(0)
    sig, x = signals(spark, scans)
    got = spatial.riemannian_tangent(spatial.covariance(sig, 4, 40, "epoch_id"), 4, F.col("epoch_id") < 24, "epoch_id")
    out = {(r.epoch_id, r.i, r.j): r.value for r in got.collect()}
    assert scans.value == 30
    cov = {(r.epoch_id, r.i, r.j): r.value for r in spatial.covariance(signals(spark, scans)[0], 4, 40, "epoch_id").collect()}
    ms = np.array([[[cov[e, i, j] for j in range(4)] for i in range(4)] for e in range(30)])
    mean = karcher(ms[:24])
    rows = spark.createDataFrame([(e, m.ravel().tolist()) for e, m in enumerate(ms[:24])], "epoch_id int, m array<double>").repartition(5)
    assert np.abs(spatial.riemannian_mean(rows, 4) - mean).max() < 1e-8
    white = eig_map(mean, lambda v: v**-0.5)
    for e in (0, 11, 29):
        want = eig_map(white @ ms[e] @ white, np.log)
        assert np.allclose([[out[e, i, j] for j in range(4)] for i in range(4)], want, atol=1e-8)


def test_common_spatial_patterns(spark):
    scans = spark.sparkContext.accumulator(0)
    sig, x = signals(spark, scans, seed=5)
    got = {(r.epoch_id, r.component): r.value for r in spatial.csp_features(sig, 4, 40, 2, F.col("epoch_id") < 24).collect()}
    assert scans.value == 30
    centred = x - x.mean(axis=2, keepdims=True)
    cov = np.einsum("eit,ejt->eij", centred, centred) / 40
    a, b = cov[:24:2].mean(axis=0), cov[1:24:2].mean(axis=0)
    white = eig_map(a + b, lambda v: v**-0.5)
    share, turn = np.linalg.eigh(white @ a @ white)
    filters = (white @ turn)[:, np.argsort(-np.abs(share - 0.5), kind="stable")[:2]].T
    for e in (0, 7, 29):
        assert [got[e, k] for k in range(2)] == pytest.approx([math.log(f @ cov[e] @ f) for f in filters], abs=1e-6)


def plain_power(x, w):
    full = np.convolve(x, w)
    same = full[len(w) // 2 : len(w) // 2 + len(x)]
    return np.abs(same) ** 2


def test_superlets_equal_direct_convolution(spark):
    fs, rng = 100.0, np.random.default_rng(2)
    x = {e: rng.normal(size=400 if e < 3 else 360) for e in range(5)}
    sig = spark.createDataFrame([(e, t, float(v)) for e, s in x.items() for t, v in enumerate(s)], "epoch_id int, t_idx int, x double").repartition(3)
    freqs, orders = [10.0, 15.0, 20.0], (1.0, 2.5)
    for equal in (False, True):
        got = {}
        for r in wavelets.superlet_power(sig, fs, freqs, orders, "epoch_id", equal=equal).collect():
            got.setdefault((r.epoch_id, r.freq), {})[r.t_idx] = r.power
        edge = max(len(wavelets.wavelet(f, 3.0 * j, fs, False)) for f, top in zip(freqs, (1, 2, 3), strict=True) for j in range(1, top + 1)) // 2
        assert len(got) == 15
        for (e, f), series in got.items():
            o = 1.0 + 1.5 * (f - 10) / 10
            whole, part = int(o), o - int(o)
            w = [1 / (o - 1 + 1)] * whole + ([part / (o - 1 + 1)] if part else [])
            w = [1.0] * len(w) if equal else w
            logs = sum(a * np.log(plain_power(x[e], wavelets.wavelet(f, 3.0 * j, fs, False))) for j, a in enumerate(w, start=1)) / sum(w)
            assert sorted(series) == list(range(edge, len(x[e]) - edge))
            assert np.allclose([series[t] for t in sorted(series)], np.exp(logs)[edge : len(x[e]) - edge])


def test_superlets_part_neighbouring_tones(spark):
    """Tones of 20 and 24 Hz show as two peaks with a valley at 22 Hz."""
    fs = 250.0
    t = np.arange(2500) / fs
    x = np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 24 * t)
    sig = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(x)], "epoch_id int, t_idx int, x double")
    mean = {r.freq: r.p for r in wavelets.superlet_power(sig, fs, [18.0, 20.0, 22.0, 24.0, 26.0], (10.0, 20.0), "epoch_id").groupBy("freq").agg(F.avg("power").alias("p")).collect()}
    assert mean[22.0] < 0.5 * min(mean[20.0], mean[24.0]) and mean[18.0] < mean[20.0] and mean[26.0] < mean[24.0]
