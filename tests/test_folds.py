"""Grids over folds from one pass, against plain loops over folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import folds
from epochlake.operators.folds import Candidate


def table(spark, x, y, fold):
    return spark.createDataFrame([(int(f), a.tolist(), b.tolist()) for f, a, b in zip(fold, x, y, strict=True)], "fold int, x array<double>, y array<double>")


def data(n, k, m, seed=0, n_folds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * rng.uniform(0.1, 9, k) + rng.uniform(-1000, 1000, k)
    x[:, k // 2] = 7.0
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    y = ((z[:, :8] @ rng.normal(size=(min(8, k), m)) + rng.normal(size=(n, m))) > 0).astype(float)
    return x, y, rng.integers(0, n_folds, n)


def f_of(x, y):
    out = []
    for j in range(x.shape[1]):
        a, b = x[y == 1, j], x[y == 0, j]
        if not len(a) or not len(b):
            out.append(0.0)
            continue
        m = x[:, j].mean()
        between = len(a) * (a.mean() - m) ** 2 + len(b) * (b.mean() - m) ** 2
        within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        out.append(between / (within / (len(x) - 2)) if within > 0 else 0.0)
    return np.array(out)


def plain_fit(x, y, c):
    """Weights and intercepts, feature by feature, row by row."""
    k, m = x.shape[1], y.shape[1]
    among = [j for j in (c.features or range(k)) if x[:, j].var() > 1e-20]
    f = np.stack([f_of(x, y[:, t]) for t in range(m)], axis=1)
    w, b = np.zeros((k, m)), np.zeros(m)
    for tasks in [list(range(m))] if c.together else [[t] for t in range(m)]:
        if c.together:
            score = np.zeros(k)
            for t in tasks:
                for rank, j in enumerate(sorted(among, key=lambda j: (-f[j, t], j))):  # noqa: B023
                    score[j] += 1 - rank / max(len(among) - 1, 1)
        else:
            score = f[:, tasks[0]]
        at = sorted(sorted(among, key=lambda j: (-score[j], j))[: c.k])  # noqa: B023
        mean, sd = x[:, at].mean(axis=0), x[:, at].std(axis=0)
        z, v = (x[:, at] - mean) / sd, y[:, tasks] - y[:, tasks].mean(axis=0)
        if c.model == "ridge":
            own = np.linalg.solve(z.T @ z + c.alpha * np.eye(len(at)), z.T @ v)
        elif c.model == "pls":
            own = nipals(z, v, c.components)
        else:
            own = proximal(z, v, c.alpha, c.l1)
        w[np.ix_(at, tasks)] = own / sd[:, None]
        b[tasks] = y[:, tasks].mean(axis=0) - (mean / sd) @ own
    return w, b


def nipals(x, y, components):
    x, y, ws, ps, qs = x.copy(), y.copy(), [], [], []
    for _ in range(components):
        u = y[:, np.argmax(y.var(axis=0))]
        for _ in range(5000):
            w = x.T @ u
            w /= np.linalg.norm(w)
            t = x @ w
            q = y.T @ t / (t @ t)
            new = y @ q / (q @ q)
            if np.linalg.norm(new - u) < 1e-13 * np.linalg.norm(new):
                break
            u = new
        p = x.T @ t / (t @ t)
        x, y = x - np.outer(t, p), y - np.outer(t, q)
        ws, ps, qs = [*ws, w], [*ps, p], [*qs, q]
    w, p, q = (np.stack(a, axis=1) for a in (ws, ps, qs))
    return w @ np.linalg.inv(p.T @ w) @ q.T


def proximal(x, y, alpha, l1):
    n = len(x)
    step = 1 / (np.linalg.eigvalsh(x.T @ x / n)[-1] + alpha)
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(20_000):
        g = x.T @ (x @ w - y) / n + alpha * (1 - l1) * w
        v = w - step * g
        w = np.sign(v) * np.maximum(abs(v) - step * alpha * l1, 0)
    return w


GRID = [
    Candidate("ridge", 5, alpha=0.5), Candidate("ridge", 5, alpha=50.0), Candidate("ridge", 12, tuple(range(3, 20)), alpha=1.0, together=True), Candidate("ridge", 99, (1, 2, 10), together=True),
    Candidate("pls", 8, components=1, together=True), Candidate("pls", 8, components=3, together=True), Candidate("elastic", 6, alpha=0.02, l1=1.0), Candidate("elastic", 6, alpha=0.1, l1=0.3, together=True),
]


def test_equals_loops_over_folds(spark):
    x, y, fold = data(240, 20, 3)
    rows = table(spark, x, y, fold).repartition(5)
    odd = spark.createDataFrame([(0, None, [1.0] * 3), (1, [float("nan")] * 20, [1.0] * 3), (None, [1.0] * 20, [1.0] * 3), (1, [1.0] * 3, [0.0] * 3)], rows.schema)
    scores, ranks, weights = folds.search(rows.unionByName(odd), 20, 3, GRID, block=7)
    got = {(r.held, r.candidate, r.task): r for r in weights.collect()}
    assert len(got) == 4 * len(GRID) * 3
    expected = np.zeros((len(GRID), 2))
    for held in (0, 1, 2, -1):
        train = fold != held
        for g, c in enumerate(GRID):
            w, b = plain_fit(x[train], y[train], c)
            for t in range(3):
                r = got[held, g, t]
                assert np.allclose(np.array(r.weights) * x.std(axis=0), w[:, t] * x.std(axis=0), atol=2e-6) and r.intercept == pytest.approx(b[t], abs=1e-3)
                assert r.used == (w[:, t] != 0).sum() or c.model == "elastic"
            if held >= 0:
                p = np.clip(x[~train] @ w + b, 0, 1)
                v = y[~train]
                ba = [((p[v[:, t] == 1, t] >= 0.5).mean() + (p[v[:, t] == 0, t] < 0.5).mean()) / 2 for t in range(3)]
                expected[g] += np.array([np.mean(ba), ((p - v) ** 2).mean()]) / 3
    by = {r.candidate: r for r in ranks.collect()}
    for g in range(len(GRID)):
        assert (by[g].balanced_accuracy, by[g].clipped_mse) == pytest.approx(tuple(expected[g]), abs=1e-6)
    order = sorted(range(len(GRID)), key=lambda g: (-round(by[g].balanced_accuracy, 9), round(by[g].clipped_mse, 9), g))
    assert [by[g].rank for g in order] == list(range(1, len(GRID) + 1))
    assert scores.count() == 3 * len(GRID) * 3


def test_many_features_and_targets(spark):
    """500 features and 64 targets, several blocks: all penalties from one decomposition equal direct solutions."""
    x, y, fold = data(700, 500, 64, seed=1, n_folds=2)
    grid = [Candidate("ridge", 100, alpha=a, together=True) for a in (1.0, 30.0, 1000.0)]
    _, ranks, weights = folds.search(table(spark, x, y, fold).repartition(4), 500, 64, grid)
    assert ranks.count() == 3
    w, b = plain_fit(x[fold != 1], y[fold != 1], grid[1])
    got = np.stack([np.array(r.weights) for r in weights.where("held = 1 AND candidate = 1").orderBy("task").collect()], axis=1)
    assert np.allclose(got * x.std(axis=0)[:, None], w * x.std(axis=0)[:, None], atol=1e-7)


def test_equal_candidates_keep_their_order(spark):
    x, y, fold = data(60, 4, 2, seed=3)
    _, ranks, _ = folds.search(table(spark, x, y, fold), 4, 2, [Candidate("ridge", 3, alpha=2.0)] * 3)
    assert [(r.candidate, r["rank"]) for r in ranks.orderBy("candidate").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_bounds_are_errors(spark):
    rows = spark.range(3).select(F.lit(0).alias("fold"), F.array(F.lit(1.0)).alias("x"), F.array(F.lit(1.0)).alias("y"))
    with pytest.raises(ValueError, match="bytes of moments"):
        folds.fold_moments(rows, 20_000, 1, 1)
    with pytest.raises(ValueError, match="folds"):
        folds.search(spark.range(9).select(F.col("id").alias("fold"), F.array(F.lit(1.0)).alias("x"), F.array(F.lit(1.0)).alias("y")), 1, 1, [Candidate("ridge", 1)], most_folds=5)
