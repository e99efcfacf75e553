"""Digests of sets, padded batches and balanced folds over any number of rows and groups."""

import random

import numpy as np
from pyspark.sql import functions as F

from epochlake.operators import shape, store, targets


def test_equal_sets_have_equal_digests(spark):
    rows = [(k % 3, k, f"t{k % 7}" if k % 11 else None) for k in range(2000)]
    df = spark.createDataFrame(rows, "run int, key long, task string")
    one = store.set_digests(df.repartition(3), "run", "key", "task")
    two = store.set_digests(df.orderBy(F.rand(5)).repartition(7), "run", "key", "task")
    assert one.exceptAll(two).count() == 0 and one.where("node = ''").count() == 3
    assert one.where("length(node) = 2").groupBy("run").agg(F.sum("n").alias("n")).where("n < 600").count() == 0


def test_a_differing_row_is_named(spark):
    df = spark.createDataFrame([("a", k) for k in range(500)], "run string, key long")
    changed = df.replace(77, 1077, ["key"])
    found = store.differing(store.set_digests(df, "run", "key"), store.set_digests(changed, "run", "key"), "run").collect()
    assert 1 <= len(found) <= 2 and all(len(r.node) == 2 for r in found)
    twice = df.union(df.where("key = 3"))
    assert len(store.differing(store.set_digests(df, "run", "key"), store.set_digests(twice, "run", "key"), "run").collect()) == 1
    assert store.differing(store.set_digests(df, "run", "key"), store.set_digests(df, "run", "key"), "run").count() == 0


def test_batches_are_bounded_and_whole(spark):
    rng = random.Random(2)
    arrays = {k: [float(k + j + 1) for j in range(rng.choice([1, 2, 3, 5, 9, 17, 100, 1000]))] for k in range(300)}
    df = spark.createDataFrame([*arrays.items(), (900, []), (901, None)], "key long, v array<double>").repartition(4)
    out = shape.batches(df, "v", "key", 400).collect()
    assert {r.key for r in out} == set(arrays)
    sizes = {}
    for r in out:
        own = arrays[r.key]
        assert r.v == own + [0.0] * (r.padded - len(own)) and r.mask == [True] * len(own) + [False] * (r.padded - len(own)) and r.length == len(own)
        assert len(r.v) <= 2 * len(own)
        sizes.setdefault(tuple(r.batch), []).append(len(r.v))
    assert all(len(set(s)) == 1 for s in sizes.values())
    assert all(sum(s) <= 400 or len(s) == 1 for s in sizes.values()) and len(sizes) > 10


def greedy(y, k, seed):
    total, folds = np.maximum(y.sum(axis=0), 1), np.zeros((k, 2))
    order = np.random.RandomState(seed).permutation(len(y))
    for g in order[np.argsort(-y[order].std(axis=1), kind="stable")]:
        spread = [np.std((folds + np.eye(k)[f][:, None] * y[g]) / total, axis=0).mean() for f in range(k)]
        folds[int(np.argmin(spread))] += y[g]
    return np.std(folds / total, axis=0).mean()


def test_folds_are_as_even_as_a_loop_over_groups(spark):
    rng = np.random.default_rng(7)
    rows = []
    for task in ("a", "b"):
        for g in range(120):
            n = int(rng.choice([1, 2, 3, 10, 40, 90]))
            rows += [(f"g{g}", task, int(rng.random() < (0.1 if task == "a" else 0.5)), len(rows) + j) for j in range(n)]
    df = spark.createDataFrame(rows, "subject string, task string, y int, key long")
    out = targets.stratified_group_kfold(df, "subject", 5, 42)
    assert out.count() == len(rows)
    assert out.groupBy("task", "subject").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    for task in ("a", "b"):
        counts = np.zeros((5, 2))
        for r in out.where(F.col("task") == task).groupBy("fold", "y").count().collect():
            counts[r.fold, r.y] = r["count"]
        assert (counts > 0).all()
        own = {}
        for s, t, y, _ in rows:
            if t == task:
                own.setdefault(s, np.zeros(2))[y] += 1
        assert np.std(counts / counts.sum(axis=0), axis=0).mean() <= greedy(np.array(list(own.values())), 5, 42) + 0.004


def test_many_groups_are_few_kinds(spark):
    df = spark.range(60_000).select(F.concat(F.lit("g"), (F.col("id") / 2).cast("long")).alias("subject"), F.lit("t").alias("task"), (F.col("id") % 2).cast("int").alias("y"))
    out = targets.stratified_group_kfold(df, "subject", 3, 1)
    assert [r["count"] for r in out.groupBy("fold").count().collect()] == [20_000] * 3
