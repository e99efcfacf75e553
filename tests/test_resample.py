"""Hashed bootstrap draws: replicates differ, tasks stay apart, incomplete draws are tried again."""

import numpy as np
import pytest

from epochlake.operators import metrics, resample
from epochlake.sources import tables


def test_hashed_draws_differ(spark):
    groups = spark.createDataFrame([(f"s{k}",) for k in range(20)], "subject string")
    reps = {}
    for r in resample.hashed_draws(groups, 300, 42).collect():
        reps.setdefault(r.rep, {})[r.subject] = r.mult
    assert len({tuple(sorted(v.items())) for v in reps.values()}) == len(reps) == 300
    counts = np.array([[v.get(f"s{k}", 0) for k in range(20)] for v in reps.values()])
    assert abs(counts.mean() - 1) < 0.05 and abs(counts.var() - 1) < 0.1
    assert np.abs(np.corrcoef(counts.T) - np.eye(20)).max() < 0.3


def test_cluster_bootstrap_keeps_tasks_apart(spark):
    from epochlake.plans import registry

    sf = "/root/testdata/sf0.001"
    stats = metrics.confusion(tables.scores_big(spark, sf), "subject", "task")
    drawn = resample.complete_draws(stats, 2000, 42)
    assert drawn.select("rep").distinct().count() == 2000
    mult = {}
    for r in drawn.collect():
        mult.setdefault(r.rep, {})[r.subject] = r.mult
    rows, values = stats.collect(), []
    for m in mult.values():
        by = {}
        for r in rows:
            by[r.task] = by.get(r.task, 0) + m.get(r.subject, 0) * np.array([r.tp, r.fn, r.tn, r.fp])
        values.append(np.mean([(tp / (tp + fn) + tn / (tn + fp)) / 2 for tp, fn, tn, fp in by.values()]))
    got = registry.queries()["u1_cluster_bootstrap"](spark, sf).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(values, (0.025, 0.975))), abs=2e-6)


def test_incomplete_draws_are_rejected(spark):
    stats = spark.createDataFrame([("x", "t", 1, 1, 0, 0), ("y", "t", 0, 0, 1, 1)], "subject string, task string, tp long, fn long, tn long, fp long")
    drawn = resample.complete_draws(stats, 50, 1)
    assert drawn.groupBy("rep").count().where("count = 2").count() == 50
    with pytest.raises(RuntimeError):
        resample.complete_draws(stats.where("subject = 'x'"), 5, 1).count()


def test_a_draw_is_hashed_once(spark):
    """The plan of the draws has one hash, and multiplicities are those of the inverted distribution."""
    import hashlib
    import math

    subjects = spark.createDataFrame([(f"s{k}",) for k in range(40)], "subject string")
    drawn = resample.repeated(subjects, 3, 60, 42)
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    steps = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    want = {}
    for rep in range(3, 60):
        for k in range(40):
            u = int(hashlib.md5(f"42|{rep}|s{k}".encode()).hexdigest()[:8], 16) / 2**32
            if n := sum(u >= s for s in steps):
                want[rep, f"s{k}"] = n
    assert {(r.rep, r.subject): r.mult for r in drawn.collect()} == want
