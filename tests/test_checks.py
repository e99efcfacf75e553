"""Audits and baselines on small tables with gaps."""

import pytest
from pyspark.sql import functions as F

from epochlake.operators import checks, metrics


def test_contract_and_classes(spark):
    df = spark.createDataFrame([("a", "t", 1, 0.7, 1), ("a", "t", 0, 0.2, 1), ("b", "t", 1, 1.2, 1), ("b", "t", 1, None, 0), ("b", "u", 0, 0.6, 1)], "subject string, task string, y int, score double, pred int")
    assert checks.contract_violations(df, 0.6).first()[:] == (5, 3)
    assert {tuple(r) for r in checks.one_class(df, "subject", "task").collect()} == {("b", "t"), ("b", "u")}
    assert metrics.brier(df.where("subject = 'a'"), "subject").first().brier == pytest.approx((0.09 + 0.04) / 2)


def test_paired_runs_and_patterns(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 0), (2, "b", 1), (3, "a", 1)], "key int, run string, y int")
    assert {(r.key, r.equal) for r in checks.paired(df, "run", ["a", "b"], "y", "key").collect()} == {(1, True), (2, False), (3, None)}
    assert checks.of_pattern(df, "run", "b").count() == 2
    with pytest.raises(ValueError):
        checks.of_pattern(df, "run")


def test_leaders_and_fractions(spark):
    df = spark.createDataFrame([("r", "s2", 0.9), ("r", "s1", 0.9), ("r", "s0", None), ("q", "s3", None)], "run string, subject string, ba double")
    assert {tuple(r) for r in checks.leaders(df, "subject", "ba", "run").collect()} == {("r", "s1", 0.9), ("q", "s3", None)}
    sig = spark.createDataFrame([(1, "c", 0.0), (1, "c", 5.0), (2, "c", 0.0), (2, "c", 0.0)], "e int, channel string, x double")
    assert checks.event_fraction(sig, F.col("x") == 0, ("e",), "channel").first()[:] == ("c", 2, 0.75, 1.0)


def test_baselines(spark):
    train = spark.createDataFrame([("t", 1), ("t", 0), ("u", 1)], "task string, y int")
    test = spark.createDataFrame([("t", k, 0) for k in range(2000)] + [("u", k, 1) for k in range(3)], "task string, key int, y int")
    assert checks.rate_scores(train, test).select("score").distinct().collect()[0][0] == pytest.approx(2 / 3)
    drawn = checks.drawn_predictions(checks.rate_scores(train, test, "task"), 7, "key", "task")
    by = {r.task: r.m for r in drawn.groupBy("task").agg(F.avg("pred").alias("m")).collect()}
    assert by["u"] == 1.0 and abs(by["t"] - 0.5) < 0.05


def test_sample_takes_trials_in_turn(spark):
    df = spark.createDataFrame([(s, t, 10 * s + t + 100 * k) for s in range(5) for t in (1, 2) for k in range(2)], "subject int, trial int, item int")
    got = {tuple(r) for r in checks.sample_stratified(df, "subject", "trial", "item", [0, 2, 4]).collect()}
    assert got == {(0, 1, 1), (2, 2, 22), (4, 1, 41)}
