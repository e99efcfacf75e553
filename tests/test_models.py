"""Values of fitted models against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import models, spatial


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 300
    x = np.round(rng.standard_normal((n, 3)) * [1.0, 2.0, 0.5], 2)
    y = (x[:, 0] - 0.4 * x[:, 1] + 0.8 * rng.standard_normal(n) > 0).astype(float)
    fold = np.arange(n) % 3
    df = spark.createDataFrame([(*map(float, r), float(c), int(f)) for r, c, f in zip(x, y, fold, strict=True)], "x1 double, x2 double, x3 double, y double, fold int").cache()
    return df, x, y, fold


X = ["x1", "x2", "x3"]


def weights(df, task="y"):
    w = {r["feature"]: r["weight"] for r in df.collect()}
    return np.array([w[c] for c in X]), w["(intercept)"]


def test_lda_with_ledoit_wolf(table):
    df, x, y, _ = table
    pooled = np.zeros((3, 3))
    for c in (0, 1):
        own = x[y == c]
        z = (own - own.mean(axis=0)) / own.std(axis=0)
        n, p = z.shape
        s = z.T @ z / n
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        spread = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / p
        amount = min(spread, delta) / delta
        pooled += ((1 - amount) * s + amount * mu * np.eye(p)) * np.outer(own.std(axis=0), own.std(axis=0)) * n / len(x)
    want = np.linalg.solve(pooled, x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0))
    got, _ = weights(models.fit_lda(df, X, None))
    assert got == pytest.approx(want)


def test_lda_leaves_out_directions_without_variance(table):
    df, x, y, _ = table
    w, _ = weights(models.fit_lda(df, X, 0.0))
    s = sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    assert w == pytest.approx(np.linalg.solve(s, x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0)))
    twice = df.withColumn("x3", F.col("x1") * 2)
    assert np.isfinite(weights(models.fit_lda(twice, X, 0.0))[0]).all()


def test_out_of_fold_scores_and_platt(table):
    df, x, y, fold = table
    oof = models.out_of_fold(df, X, "y", "fold", 3)
    want = np.zeros(len(x))
    for f in range(3):
        a, b = x[fold != f], 2 * y[fold != f] - 1
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(3), (a - a.mean(0)).T @ (b - b.mean()))
        want[fold == f] = (x[fold == f] - a.mean(0)) @ w + b.mean()
    got = oof.select("x1", "x2", "x3", "score").collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want))
    p = models.platt(oof).first()
    prob = 1 / (1 + np.exp(-(p["a"] * want + p["b"])))
    assert abs((prob - y).sum()) < 1e-6 and abs(((prob - y) * want).sum()) < 1e-6
    with pytest.raises(ValueError):
        models.out_of_fold(df, X, "y", "fold", 2)


def test_hinge_comes_near_the_least_loss(table):
    df, x, y, _ = table
    w, b = weights(models.fit_hinge(df, X, "y", 0.1))
    loss = lambda w, b: np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean() + 0.05 * w @ w
    best, at = np.inf, np.zeros(4)
    v = np.zeros(4)
    for t in range(1, 20001):
        m = (2 * y - 1) * (x @ v[:3] + v[3]) < 1
        g = np.append(x[m].T @ (2 * y[m] - 1), (2 * y[m] - 1).sum()) / len(y) - 0.1 * np.append(v[:3], 0)
        v = v + g / (0.1 * (t + 10))
        if (now := loss(v[:3], v[3])) < best:
            best, at = now, v.copy()
    assert loss(w, b) <= best + 0.02 and np.abs(at).max() > 0


def test_logistic_grid_selects_and_refits(spark, table):
    df, x, y, fold = table
    grid = [{"k": 2, "c": 1.0, "l1": 0.0, "balanced": False}, {"k": 3, "c": 1.0, "l1": 0.0, "balanced": True}]
    candidates, best = models.fit_logistic_grid(df, X, "y", "fold", grid)
    rows = candidates.orderBy("candidate").collect()

    def fit(a, b, balanced):
        n = len(b)
        weight = np.where(b == 1, n / (2 * b.sum()), n / (2 * (n - b.sum()))) if balanced else np.ones(n)
        z, w = np.c_[a, np.ones(n)], np.zeros(a.shape[1] + 1)
        penalty = np.append(np.full(a.shape[1], 1 / n), 0) * weight.sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(penalty), z.T @ (weight * (p - y_of(b))) + penalty * w)
        return w

    y_of = lambda b: b
    want = []
    for g in grid:
        recalls = []
        for f in range(3):
            a, b = x[fold != f], y[fold != f]
            score = [np.square([a[b == c, j].mean() - a[:, j].mean() for c in (0, 1)]) @ [(b == c).sum() for c in (0, 1)] / sum(((a[b == c, j] - a[b == c, j].mean()) ** 2).sum() for c in (0, 1)) for j in range(3)]
            cols = sorted(np.argsort(-np.array(score))[: g["k"]])
            w = fit(a[:, cols], b, g["balanced"])
            pred = (x[fold == f][:, cols] @ w[:-1] + w[-1] > 0).astype(float)
            recalls.append(np.mean([(pred[y[fold == f] == c] == c).mean() for c in (0, 1)]))
        want.append(np.mean(recalls))
    assert [r["score"] for r in rows] == pytest.approx(want, abs=1e-6)
    assert {r["rank"] for r in rows} == {1, 2}
    top = next(g for g, r in zip(grid, rows, strict=True) if r["rank"] == 1)
    got, _ = weights(best)
    full = fit(x, y, top["balanced"]) if top["k"] == 3 else None
    assert full is None or got == pytest.approx(full[:-1], abs=1e-3)


def test_riemannian_mean_of_commuting_matrices(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    values = np.exp(rng.standard_normal((6, 3)))
    rows = [(k, i, j, float((turn * v @ turn.T)[i, j])) for k, v in enumerate(values) for i in range(3) for j in range(3)]
    cov = spark.createDataFrame(rows, "epoch_id int, i int, j int, value double")
    want = turn * np.exp(np.log(values).mean(axis=0)) @ turn.T
    assert spatial.riemannian_mean(spatial.matrices(cov, 3, "epoch_id"), 3) == pytest.approx(want)


def test_xdawn_covariances_equal_numpy(spark):
    rng = np.random.default_rng(6)
    epochs, channels, n = 12, 3, 20
    y = np.arange(epochs) % 2
    x = rng.standard_normal((epochs, channels, n)) + y[:, None, None] * np.sin(np.arange(n) / 3) * np.array([1.0, 0.2, 0.0])[:, None]
    rows = [(e, int(y[e]), c, t, float(x[e, c, t])) for e in range(epochs) for c in range(channels) for t in range(n)]
    sig = spark.createDataFrame(rows, "epoch_id int, y int, ch_idx int, t_idx int, x double")
    cov, size = spatial.xdawn_covariances(sig, channels, n, 1, F.col("epoch_id") < 10)
    centre = lambda m: m - m.mean(axis=-1, keepdims=True)
    train = x[:10]
    noise = np.mean([centre(e) @ centre(e).T / n for e in train], axis=0)
    values, vectors = np.linalg.eigh(noise)
    white = vectors / np.sqrt(values) @ vectors.T
    evoked = [train[y[:10] == c].mean(axis=0) for c in (0, 1)]
    bank = [(white @ np.linalg.eigh(white @ (centre(e) @ centre(e).T / n) @ white)[1][:, -1])[None] for e in evoked]
    fixed = np.concatenate([f @ e for f, e in zip(bank, evoked, strict=True)])
    got = {r["epoch_id"]: np.array(r["m"]).reshape(size, size) for r in spatial.matrices(cov, size, "epoch_id").collect()}
    assert size == 4 and len(got) == epochs
    for e in range(epochs):
        both = centre(np.concatenate((fixed, np.concatenate(bank) @ x[e])))
        c = both @ both.T / n
        mu, alpha = np.trace(c) / 4, (c * c).mean()
        s = min(1.0, (alpha + mu * mu) / ((n + 1) * (alpha - mu * mu / 4)))
        want = (1 - s) * c + s * mu * np.eye(4)
        assert np.abs(got[e]) == pytest.approx(np.abs(want))


def test_probabilities_of_other_subjects(spark):
    """Scores of every fifth subject by a model of the others, with a penalty of 0.01 on standardised features."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2)) * [1.0, 3.0]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(k % 10, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "subject int, x1 double, x2 double, y double")
    train = np.arange(400) % 5 != 0
    sd = x[train].std(axis=0, ddof=1)
    z = np.hstack((x / sd, np.ones((400, 1))))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[train] @ w))
        g = z[train].T @ (p - y[train]) / train.sum() + 0.01 * np.append(w[:2], 0)
        w -= np.linalg.solve(z[train].T @ (z[train] * (p * (1 - p))[:, None]) / train.sum() + 0.01 * np.diag([1, 1, 0]), g)
    out = models.predict_logistic(df, ["x1", "x2"], "y").collect()
    want = 1 / (1 + np.exp(-z[~train] @ w))
    assert len(out) == 80 and sorted(r.score for r in out) == pytest.approx(sorted(want), abs=1e-4)
    assert all(r.pred == (r.score >= 0.5) for r in out)


def test_linear_svm_comes_near_the_least_loss(table):
    df, x, y, _ = table
    got = {r["feature"]: r["weight"] for r in models.fit_ml(df.withColumnRenamed("y", "y1"), X, ["y1"], "svm").collect()}
    z, sign = x / x.std(axis=0, ddof=1), 2 * y - 1
    own = np.array([got[c] for c in X]) * x.std(axis=0, ddof=1)
    loss = lambda w, b: np.maximum(0, 1 - sign * (z @ w + b)).mean() + 0.005 * (w @ w)
    w, b, best = np.zeros(3), 0.0, np.inf
    for t in range(1, 30_000):
        short = sign * (z @ w + b) < 1
        w, b = w - (0.01 * w - (sign[short, None] * z[short]).sum(axis=0) / len(z)) / (0.01 * t + 10), b + sign[short].sum() / len(z) / (0.01 * t + 10)
        best = min(best, loss(w, b))
    assert min(loss(own, c) for c in np.linspace(-2, 2, 2001)) <= 1.02 * best


def test_elastic_net_meets_its_optimum(table):
    """At the weights the gradient of the squared error is that of the penalty (share one half, 0.01 in all)."""
    df, x, y, _ = table
    got = {r["feature"]: r["weight"] for r in models.fit_ml(df.withColumnRenamed("y", "y1"), X, ["y1"], "elastic").collect()}
    sx, sy = x.std(axis=0, ddof=1), y.std(ddof=1)
    z, v = (x - x.mean(axis=0)) / sx, (y - y.mean()) / sy
    w = np.array([got[c] for c in X]) * sx / sy
    g = z.T @ (z @ w - v) / len(z)
    alpha = 0.01 / sy
    for a, b in zip(g, w, strict=True):
        if b:
            assert a + alpha * (0.5 * np.sign(b) + 0.5 * b) == pytest.approx(0, abs=2e-3)
        else:
            assert abs(a) <= 0.5 * alpha + 2e-3
