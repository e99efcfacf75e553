"""Cluster bootstrap on sufficient statistics, intervals, paired comparison, multiplicity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochlake.functions.columns import balanced
from epochlake.operators.store import kept


def draws(spark: SparkSession, groups: list, n: int, seed: int) -> DataFrame:
    """Multiplicities of groups drawn with replacement: rep, the group's column, mult. Size: at most n * groups."""
    rng = np.random.default_rng(seed)
    rows = []
    for rep in range(n):
        which, mult = np.unique(rng.choice(len(groups), len(groups)), return_counts=True)
        rows += [(rep, groups[i], int(m)) for i, m in zip(which, mult, strict=True)]
    kind = "long" if isinstance(groups[0], int) else "string"
    return spark.createDataFrame(rows, f"rep int, subject {kind}, mult long")


#: Chances that a Poisson variable of mean one is at most 0, 1, 2, ...; beyond the last is less than one in 2^32.
POISSON_STEPS = tuple(math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


#: The same as eight hex digits, of which a draw has to reach one more for each time that a subject is taken.
HEX_STEPS = tuple(f"{n:08x}" for s in POISSON_STEPS if (n := math.ceil(s * (1 << 32))) < 1 << 32)


def with_mult(df: DataFrame, seed: int) -> DataFrame:
    """Rows with the multiplicity mult of their subject in their replicate, a Poisson variable of mean one; those of 0 go.

    By inversion of the first 32 bits of the MD5 of seed, replicate and subject, whose hex digits are in the order of the
    numbers. (A CRC is linear: with it the draws of two replicates differ by one constant.) Exploding an array of one
    value computes the hash once, where the filter would repeat it for each step.
    """
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col("subject").cast("string"))
    drawn = df.select("*", F.explode(F.array(F.substring(F.md5(text), 1, 8))).alias("_h")).where(F.col("_h") >= HEX_STEPS[0])
    mult = F.when(F.col("_h") < HEX_STEPS[1], 1)
    for k, step in enumerate(HEX_STEPS[2:], start=2):
        mult = mult.when(F.col("_h") < step, k)
    return drawn.withColumn("mult", mult.otherwise(len(HEX_STEPS)).cast("long")).drop("_h")


def repeated(rows: DataFrame, first: int, end: int, seed: int) -> DataFrame:
    """A row of each subject for each replicate of [first, end) that draws it: rep, mult. Nothing is joined or shuffled."""
    return with_mult(rows.where("subject IS NOT NULL").withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))), seed)


def hashed_draws(groups: DataFrame, n: int, seed: int) -> DataFrame:
    """Multiplicities by a Poisson draw from a hash of replicate and group: any number of groups, no driver, any engine."""
    return repeated(groups.select("subject").distinct(), 0, n, seed).select("rep", "subject", "mult")


def complete_bootstrap(stats: DataFrame, n: int, seed: int, most: int = 100) -> DataFrame:
    """Mean balanced accuracy of the first n replicates in which every task has both classes: rep, value.

    A subject is one row with the counts of its tasks, drawn once for all of them. Attempts are numbered from 0; as long
    as fewer than n are complete, as many again as were made follow, at most `most` for each; then it is an error. What
    was computed is kept, and the n rows are.
    """
    subjects = kept(stats.where("subject IS NOT NULL").groupBy("subject").agg(F.collect_list(F.struct("task", "tp", "fn", "tn", "fp")).alias("tasks")))
    # few rows that become many: they are spread before, for what is small to read would be one task's
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps, tried, end = None, 0, n
    while True:
        drawn = repeated(subjects.repartition(tasks, "subject"), tried, end, seed).select("rep", "mult", F.inline("tasks"))
        more = kept(bootstrap_sums(drawn))
        reps = more if reps is None else reps.unionByName(more)
        if reps.count() >= n:
            return reps.withColumn("r", F.row_number().over(Window.orderBy("rep"))).where(F.col("r") <= n).drop("r")
        if end >= n * most:
            raise RuntimeError(f"after {end} attempts fewer than {n} replicates have both classes in every task")
        tried, end = end, min(2 * end, n * most)


def complete_draws(stats: DataFrame, n: int, seed: int) -> DataFrame:
    """Hashed draws of the replicates of complete_bootstrap: rep, subject, mult."""
    reps = complete_bootstrap(stats, n, seed).select("rep")
    return with_mult(stats.where("subject IS NOT NULL").select("subject").distinct().crossJoin(F.broadcast(reps)), seed)


def bootstrap_metrics(df: DataFrame, drawn: DataFrame, sample: str, *key: str, decimals: int | None = None) -> DataFrame:
    """Balanced accuracy, mean squared score error, mean sample IoU and Hamming loss per key and replicate.

    Every metric is made of sums that add up over subjects; the draws are class-complete (see complete_draws). Errors of
    scores with so many decimals are summed as whole numbers, which is exact in any order. Also n and, as sums behind
    the two ratios, wrong and squared (in units of 10 ** -2 decimals).
    """
    y, p, d = F.col("y") == 1, F.col("pred") == 1, F.col("score") - F.col("y")
    if decimals is not None:
        d = F.round(d * 10**decimals).cast("long")
    unit = 1 if decimals is None else 10 ** (2 * decimals)
    one = lambda c: F.sum(c.cast("long"))
    cells = df.groupBy(*key, "subject", "task").agg(one(y & p).alias("tp"), one(y & ~p).alias("fn"), one(~y & ~p).alias("tn"), one(~y & p).alias("fp"), F.sum(d * d).alias("sq"))
    names = ("tp", "fn", "tn", "fp", "sq")
    per = cells.join(drawn, "subject").groupBy(*key, "rep", "task").agg(*(F.sum(F.col(c) * F.col("mult")).alias(c) for c in names))
    n = F.sum(F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp"))
    most = per.groupBy(*key, "rep").agg(F.avg(balanced(*(F.col(c) for c in names[:4]))).alias("balanced_accuracy"), (F.sum("sq") / (n * unit)).alias("score_mse"), (F.sum(F.col("fn") + F.col("fp")) / n).alias("hamming_loss"), n.alias("n"), F.sum(F.col("fn") + F.col("fp")).alias("wrong"), F.sum("sq").alias("squared"))
    rows = df.groupBy(*key, "subject", sample).agg(one(y & p).alias("i"), one(y | p).alias("u"))
    iou = F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.col("u"))
    units = rows.groupBy(*key, "subject").agg(F.sum(iou).alias("iou"), F.count("*").alias("n"))
    shared = units.join(drawn, "subject").groupBy(*key, "rep").agg((F.sum(F.col("iou") * F.col("mult")) / F.sum(F.col("n") * F.col("mult"))).alias("sample_iou"))
    return most.join(shared, [*key, "rep"]).select(*key, "rep", "balanced_accuracy", "score_mse", "sample_iou", "hamming_loss", "n", "wrong", "squared")


def bootstrap(stats: DataFrame, drawn: DataFrame, kept: int | None = None) -> DataFrame:
    """Mean balanced accuracy over tasks per replicate, from (subject, task) -> tp, fn, tn, fp and multiplicities.

    Replicates that lack a class in any task are left out; with kept, the first so many others stay. The cost is
    subjects times tasks times replicates, whatever the number of rows behind the statistics.
    """
    return bootstrap_sums(stats.join(drawn, "subject"), kept)


def bootstrap_sums(drawn: DataFrame, kept: int | None = None) -> DataFrame:
    """The same from the statistics of the drawn subjects: rep, mult, task and the four counts."""
    parts = [F.sum(F.col(c) * F.col("mult")).alias(c) for c in ("tp", "fn", "tn", "fp")]
    per = drawn.groupBy("rep", "task").agg(*parts)
    ok = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    reps = per.groupBy("rep").agg(F.min(ok.cast("int")).alias("ok"), F.avg(F.when(ok, balanced(*(F.col(c) for c in ("tp", "fn", "tn", "fp"))))).alias("value")).where("ok = 1").drop("ok")
    if kept is not None:
        reps = reps.withColumn("r", F.row_number().over(Window.orderBy("rep"))).where(F.col("r") <= kept).drop("r")
    return reps


def percentile_interval(reps: DataFrame, value: Column, alpha: float, *key: str) -> DataFrame:
    return reps.groupBy(*key).agg(F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).select(*key, F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))


def sign_p(value: Column) -> Column:
    """Two-sided sign probability of replicates, an aggregate."""
    return F.least(F.lit(1.0), 2 * F.least(F.avg((value <= 0).cast("double")), F.avg((value >= 0).cast("double"))))


def holm(df: DataFrame, p: str, order: tuple[str, ...], *key: str) -> DataFrame:
    """Holm's step-down adjustment within keys."""
    w = Window.partitionBy(*key).orderBy(p, *order)
    step = (F.count("*").over(Window.partitionBy(*key)) - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("step", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")
