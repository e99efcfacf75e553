"""Logistic models of many candidates, folds and targets in one, against single fits."""

import numpy as np
import pytest
from test_folds import data, f_of, table

from epochlake.operators import logits
from epochlake.operators.logits import Logit


def single(x, y, c):
    """One model by accelerated proximal descent on all rows."""
    at = [j for j in (c.features or range(x.shape[1])) if x[:, j].var() > 1e-20]
    f = f_of(x, y)
    at = sorted(sorted(at, key=lambda j: (-f[j], j))[: c.k])
    mean, sd = x[:, at].mean(axis=0), x[:, at].std(axis=0)
    z = np.hstack(((x[:, at] - mean) / sd, np.ones((len(x), 1))))
    by = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if c.balanced else np.ones(len(y))
    free = np.append(np.ones(len(at)), 0.0)
    step = 1 / (np.linalg.eigvalsh(z.T @ (z * by[:, None]))[-1] / 4 + (1 - c.l1) / c.c)
    w = v = np.zeros(len(at) + 1)
    t = 1.0
    for _ in range(40_000):
        g = z.T @ (by * (1 / (1 + np.exp(-z @ v)) - y)) + (1 - c.l1) / c.c * free * v
        new = v - step * g
        new = np.sign(new) * np.maximum(abs(new) - step * c.l1 / c.c * free, 0)
        if (new - w) @ (v - new) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / after * (new - w), after
    out = np.zeros(x.shape[1])
    out[at] = w[:-1] / sd
    return out, w[-1] - mean @ out[at]


GRID = [Logit(4, 1.0), Logit(4, 0.05, 0.0, True), Logit(9, 0.2, 1.0), Logit(6, 0.5, 0.5, True, (0, 1, 2, 5, 9, 11))]


def test_equals_single_fits(spark):
    x, y, fold = data(180, 12, 2, seed=5)
    rows = table(spark, x, y, fold).repartition(4)
    scores, ranks, weights = logits.search(rows, 12, 2, GRID)
    got = {(r.held, r.candidate, r.task): r for r in weights.collect()}
    assert len(got) == 4 * len(GRID) * 2
    means = np.zeros(len(GRID))
    for held in (-1, 0, 1, 2):
        train = fold != held
        for g, c in enumerate(GRID):
            for t in range(2):
                w, b = single(x[train], y[train, t], c)
                r = got[held, g, t]
                assert np.abs((np.array(r.weights) - w) * x.std(axis=0)).max() < 1e-6
                assert np.array(r.weights) @ x.mean(axis=0) + r.intercept == pytest.approx(w @ x.mean(axis=0) + b, abs=1e-6)
                if held >= 0:
                    said, v = x[~train] @ w + b >= 0, y[~train, t]
                    means[g] += (said[v == 1].mean() + (~said[v == 0]).mean()) / 2 / 6
    assert [r.balanced_accuracy for r in ranks.orderBy("candidate").collect()] == pytest.approx(means.tolist(), abs=1e-9)
    assert (np.array(got[-1, 2, 0].weights) == 0).sum() > 3 and scores.count() == 3 * len(GRID) * 2


def test_passes_do_not_follow_the_number_of_models(spark):
    x, y, fold = data(150, 6, 2, seed=7)
    rows = logits.kept(logits.whole_rows(table(spark, x, y, fold), 6, 2))
    passes = []
    for grid in ([Logit(6, 0.5)], [Logit(k, 0.5) for k in (6, 6, 5, 4)]):
        chosen = logits.choices(logits.fold_moments(rows, 6, 2, 3), 6, 2, [0, 1, 2], grid)
        passes.append(logits.fit_all(rows, chosen, grid)[1])
    assert passes[1] <= passes[0] + 3 and passes[0] < 15


def test_separable_classes_come_to_rest(spark):
    """Steps that overshoot are halved; the penalty keeps weights finite."""
    x = np.array([[-9.0, 1.0], [-8.5, 0.0], [8.0, 1.0], [9.5, 0.0]])
    rows = table(spark, x, np.array([[0.0], [0.0], [1.0], [1.0]]), np.zeros(4))
    w = logits.one_vs_rest(rows.selectExpr("x", "y[0] AS y"), 2, 2, Logit(2, 1e4)).orderBy("task").collect()
    assert w[1].weights[0] > 0 and w[0].weights[0] == pytest.approx(-w[1].weights[0], rel=1e-6)


def test_classes_against_the_rest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5))
    y = rng.integers(0, 3, 120)
    x[np.arange(120), y] += 2
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int")
    got = logits.one_vs_rest(df, 5, 3, Logit(5, 0.3)).orderBy("task").collect()
    for c in range(3):
        w, b = single(x, (y == c).astype(float), Logit(5, 0.3))
        assert np.allclose(got[c].weights, w, atol=1e-6) and got[c].intercept == pytest.approx(b, abs=1e-6)


def test_equal_rows_are_read_as_one(spark, monkeypatch):
    """Passes go over distinct rows with their numbers; scores and weights are those of all rows."""
    x, y, fold = data(60, 3, 2, seed=9)
    times = np.arange(60) % 4 + 1
    many = table(spark, np.repeat(x, times, axis=0), np.repeat(y, times, axis=0), np.repeat(fold, times))
    read = []
    sums = logits.sums
    monkeypatch.setattr(logits, "sums", lambda rows, states: (read.append(rows.count()), sums(rows, states))[1])
    scores, _, weights = logits.search(many, 3, 2, [Logit(2, 0.5), Logit(3, 1.0, 0.5, True)])
    assert set(read) == {60}
    got = {(r.held, r.candidate, r.task): (r.weights, r.intercept) for r in weights.collect()}
    for t in range(2):
        rest = np.repeat(fold, times) != 1
        w, b = single(np.repeat(x, times, axis=0)[rest], np.repeat(y, times, axis=0)[rest, t], Logit(3, 1.0, 0.5, True))
        assert np.allclose(got[1, 1, t][0], w, atol=1e-6) and got[1, 1, t][1] == pytest.approx(b, abs=1e-6)
    z = 1 / (1 + np.exp(-(x @ np.array(got[1, 1, 0][0]) + got[1, 1, 0][1])))
    own = fold == 1
    mse = ((z - y[:, 0]) ** 2)[own] @ times[own] / times[own].sum()
    assert {(r.fold, r.candidate, r.task): r.clipped_mse for r in scores.collect()}[1, 1, 0] == pytest.approx(mse, abs=1e-9)
