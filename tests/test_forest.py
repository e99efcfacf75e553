"""Forests of several targets against a plain recursive version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import forest


def rows_of(spark, x, y):
    return spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "key long, x array<double>, y array<double>")


def plain(x, y, w, depth, least, features=None):
    """A nested tree by trying every split of every feature."""
    value = (w[:, None] * y).sum(axis=0) / w.sum()
    error = lambda k: ((w[k, None] * y[k]).sum(axis=0) ** 2).sum() / w[k].sum()
    top = (1e-12 * max(1.0, w.sum()), None)
    all_rows = np.ones(len(x), dtype=bool)
    if depth:
        for j in range(x.shape[1]):
            for v in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= v
                if w[left].sum() >= least and w[~left].sum() >= least:
                    gain = round(error(left) + error(~left) - error(all_rows), 9)
                    if gain > top[0]:
                        top = (gain, (j, v, left))
    if top[1] is None:
        return {"value": value}
    j, v, left = top[1]
    return {"value": value, "feature": j, "threshold": v, "left": plain(x[left], y[left], w[left], depth - 1, least), "right": plain(x[~left], y[~left], w[~left], depth - 1, least)}


def same(tree, k, want):
    node = tree[k]
    assert node["value"] == pytest.approx(want["value"], abs=1e-9)
    assert (node["feature"] >= 0) == ("feature" in want)
    if "feature" in want:
        assert node["feature"] == want["feature"] and node["threshold"] == pytest.approx(want["threshold"])
        same(tree, node["left"], want["left"])
        same(tree, node["right"], want["right"])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(160, 5)), 2)
    x[:, 4] = 1.0
    y = np.stack([x[:, 0] > 0.3, x[:, 1] + x[:, 2] > 0, rng.random(160) > 0.5], axis=1).astype(float)
    return x, y


def test_one_tree_equals_plain_version(spark, data):
    x, y = data
    got = forest.fit(rows_of(spark, x, y).repartition(3), 5, 3, trees=1, depth=4, least=6, bins=500, bootstrap=False)
    same(got.trees[0], 0, plain(x, y, np.ones(len(x)), 4, 6))


def test_drawn_trees_equal_plain_versions_of_their_draws(spark, data):
    x, y = data
    got = forest.fit(rows_of(spark, x, y).repartition(4), 5, 3, trees=3, depth=3, least=4, bins=500, seed=7)
    drawn = [forest.multiplicities(np.arange(len(x)), t, 7) for t in range(3)]
    assert len({tuple(d) for d in drawn}) == 3 and abs(np.mean(drawn) - 1) < 0.15
    for tree, w in zip(got.trees, drawn, strict=True):
        has = w > 0
        same(tree, 0, plain(x[has], y[has], w[has], 3, 4))
    p = {r.key: r.p for r in forest.predict(rows_of(spark, x, y), got, 5).collect()}
    for k in range(0, len(x), 13):
        mean = np.mean([tree[forest.places(tree, x[k : k + 1])[0]]["value"] for tree in got.trees], axis=0)
        assert p[k] == pytest.approx(mean)
    assert got.importances(5).sum() == pytest.approx(1) and got.importances(5)[4] == 0


def test_levels_in_portions_and_feature_shares(spark, data, monkeypatch):
    x, y = data
    one = forest.fit(rows_of(spark, x, y), 5, 3, trees=4, depth=3, share=0.4, bins=16)
    monkeypatch.setattr(forest, "MOST_BYTES", 1)
    two = forest.fit(rows_of(spark, x, y), 5, 3, trees=4, depth=3, share=0.4, bins=16)
    for a, b in zip(one.trees, two.trees, strict=True):
        assert [(n["feature"], n["threshold"], n["left"]) for n in a] == [(n["feature"], n["threshold"], n["left"]) for n in b]
    assert len({t[0]["feature"] for t in one.trees}) > 1


def test_many_values_are_cut_at_quantiles(spark):
    rows = spark.range(20000).select(F.col("id").alias("key"), F.array(F.col("id").cast("double"), F.lit(3.0)).alias("x"), F.array((F.col("id") > 5000).cast("double")).alias("y"))
    cuts = forest.thresholds(rows.repartition(4), 2, 8)
    assert len(cuts[1]) == 0 and np.abs(cuts[0] - np.arange(1, 8) * 2500).max() < 60
    odd = spark.createDataFrame([(1, None, [1.0]), (2, [1.0, float("nan")], [1.0]), (None, [1.0, 1.0], [0.0])], "key long, x array<double>, y array<double>")
    assert forest.fit(rows.unionByName(odd), 2, 1, trees=1, depth=1, bootstrap=False).trees[0][0]["weight"] == 20000
    with pytest.raises(ValueError, match="too large"):
        forest.fit(rows, 2, 1, trees=1, depth=30)
