"""Targets, group splits, folds and leakage audits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlake.operators.running import numbered

#: Groups that a driver-side permutation may list; more is an error, since the list is dealt and broadcast (megabytes).
MOST_GROUPS = 100_000


def pixel_targets(images: DataFrame, *key: str) -> DataFrame:
    """Binary images (array of rows) to tasks pixel_r{r}_c{c} with their 0/1 value."""
    rows = images.select(*key, F.posexplode("img").alias("r", "row"))
    return rows.select(*key, "r", F.posexplode("row").alias("c", "y")).select(*key, F.format_string("pixel_r%d_c%d", "r", "c").alias("task"), F.col("y").cast("int").alias("y"))


def group_list(df: DataFrame, group: str) -> list:
    """Sorted distinct groups, bounded."""
    rows = df.select(group).distinct().orderBy(group).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return [r[0] for r in rows]


def group_shuffle_split(df: DataFrame, group: str, test_size: float, seed: int) -> DataFrame:
    """Rows with side 'train' or 'test': ceil(test_size * groups) groups of a seeded permutation are test."""
    groups = group_list(df, group)
    order = np.random.RandomState(seed).permutation(len(groups))
    test = math.ceil(test_size * len(groups))
    sides = [(groups[k], "test" if n < test else "train") for n, k in enumerate(order.tolist())]
    table = df.sparkSession.createDataFrame(sides, f"`{group}` {df.schema[group].dataType.simpleString()}, side string")
    return df.join(F.broadcast(table), group)


def group_kfold(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Rows with a fold: shuffled groups dealt into k nearly equal parts."""
    groups = group_list(df, group)
    parts = np.array_split(np.random.RandomState(seed).permutation(len(groups)), k)
    fold = {groups[i]: n for n, part in enumerate(parts) for i in part}
    table = df.sparkSession.createDataFrame(list(fold.items()), f"`{group}` {df.schema[group].dataType.simpleString()}, fold int")
    return df.join(F.broadcast(table), group)


def count_class(n: Column) -> Column:
    """Counts under 64 as they are, larger ones to two significant binary places after the first: about 12 % apart."""
    unit = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 3))
    return F.when(n < 64, n).otherwise((F.floor(n / unit) * unit).cast("long"))


def stratified_group_kfold(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Rows (with task and y) with a fold per task: groups stay whole, folds get nearly equal class counts.

    Counts per task, group and class are made in Spark. Groups whose counts are alike (see count_class) are one kind and
    are numbered in an order by hash; a kind's groups are dealt evenly, and what is left over goes where the class counts
    deviate least, kinds with the largest spread first. The driver sees kinds, of which there are a few thousand for a task
    whatever the number of groups.
    """
    counts = df.groupBy("task", group).agg(F.sum(1 - F.col("y").cast("long")).alias("zero"), F.sum(F.col("y").cast("long")).alias("one"))
    counts = counts.withColumn("zeros", count_class(F.col("zero"))).withColumn("ones", count_class(F.col("one")))
    counts = numbered(counts, ("task", "zeros", "ones"), (F.xxhash64(F.lit(seed), F.col(group)), group), "place")
    kinds = counts.groupBy("task", "zeros", "ones").agg(F.count("*").alias("n"), F.avg("zero").alias("zero"), F.avg("one").alias("one")).collect()
    rows = []
    for task in sorted({r["task"] for r in kinds}):
        own = [r for r in kinds if r["task"] == task]
        y = np.array([[r["zero"], r["one"]] for r in own], dtype=float)
        n = np.array([r["n"] for r in own])
        total = np.maximum((y * n[:, None]).sum(axis=0), 1)
        folds = np.tile(((n // k)[:, None] * y).sum(axis=0), (k, 1))
        for g in sorted(range(len(own)), key=lambda g: (-y[g].std(), -y[g].sum(), own[g]["zeros"], own[g]["ones"])):  # noqa: B023
            rest = []
            for _ in range(n[g] % k):
                spread = [np.std((folds + np.eye(k)[f][:, None] * y[g]) / total, axis=0).mean() for f in range(k)]
                best = min(range(k), key=lambda f: (round(spread[f], 12), folds[f].sum(), f))  # noqa: B023
                folds[best] += y[g]
                rest.append(best)
            rows.append((task, own[g]["zeros"], own[g]["ones"], int(n[g] // k * k), rest))
    plan = df.sparkSession.createDataFrame(rows, "task string, zeros long, ones long, even long, rest array<int>")
    fold = F.when(F.col("place") < F.col("even"), F.col("place") % k).otherwise(F.element_at("rest", (F.col("place") - F.col("even") + 1).cast("int"))).cast("int")
    dealt = counts.join(plan, ["task", "zeros", "ones"]).select("task", group, fold.alias("fold"))
    return df.join(dealt, ["task", group])


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """Every row once per group as direction, 'test' where it belongs to it; the groups are a bounded list.

    The rows are as many as rows times groups; where only counts are wanted, leave_one_out_counts needs no such rows.
    """
    kind = df.schema[group].dataType.simpleString()
    known = df.sparkSession.createDataFrame([(group_list(df, group),)], f"directions array<{kind}>")
    spread = df.crossJoin(F.broadcast(known)).withColumn("direction", F.explode("directions")).drop("directions")
    return spread.withColumn("side", F.when(F.col(group) == F.col("direction"), "test").otherwise("train"))


def leave_one_out_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows on each side of each direction, from the counts of the groups: direction, side, n."""
    per = df.groupBy(F.col(group).alias("direction")).agg(F.count("*").alias("own"))
    both = per.join(F.broadcast(per.agg(F.sum("own").alias("total"))))
    sides = F.array(F.struct(F.lit("test").alias("side"), F.col("own").alias("n")), F.struct(F.lit("train").alias("side"), (F.col("total") - F.col("own")).alias("n")))
    return both.select("direction", F.explode(sides).alias("s")).select("direction", "s.side", "s.n").where("n > 0")


def within_subject(df: DataFrame, subject: str, trial: str) -> DataFrame:
    """Both directions between trials 1 and 2 of the subjects that have both."""
    both = df.groupBy(subject).agg(F.collect_set(trial).alias("t")).where(F.array_contains("t", 1) & F.array_contains("t", 2)).select(subject)
    own = df.join(both, subject, "left_semi").where(F.col(trial).isin(1, 2))
    side = lambda t: F.when(F.col(trial) == t, "train").otherwise("test")
    return own.withColumn("direction", F.lit("1->2")).withColumn("side", side(1)).unionByName(own.withColumn("direction", F.lit("2->1")).withColumn("side", side(2)))


def overlaps(split: DataFrame, attributes: list[str]) -> DataFrame:
    """Values of each attribute that stand on both sides of a direction: direction, attribute, n, values."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))
    rows = split.select("direction", "side", F.explode(pairs).alias("p")).where(F.col("p.value").isNotNull())
    seen = rows.groupBy("direction", "p.attribute", "p.value").agg(F.countDistinct("side").alias("sides"))
    return seen.groupBy("direction", "attribute").agg(F.sum((F.col("sides") == 2).cast("long")).alias("n"))


def positives(split: DataFrame) -> DataFrame:
    """Positive counts per direction, side and task, and whether both classes are there."""
    p = F.sum(F.col("y").cast("long"))
    return split.groupBy("direction", "side", "task").agg(p.alias("positives"), F.count("*").alias("n"), ((p > 0) & (p < F.count("*"))).alias("both_classes"))


def align(features: DataFrame, target: DataFrame, *key: str) -> DataFrame:
    """One-to-one equi-join; a key that repeats on either side is an error."""
    for side, name in ((features, "features"), (target, "targets")):
        if not side.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated keys in {name}")
    return features.join(target, list(key))


def number_within(df: DataFrame, *group: str, order: tuple[Column | str, ...]) -> DataFrame:
    """Running number from 0 within groups in the given order; a group of any size is spread over ranges."""
    return numbered(df, group, order, "epoch_index").withColumn("epoch_index", F.col("epoch_index").cast("int"))
