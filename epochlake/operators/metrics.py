"""Metrics of predictions as sums: tasks, samples, classes, ranks, calibration, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlake.functions.columns import balanced, macro_f1, safe_div
from epochlake.operators.running import running_sums


def confusion(df: DataFrame, *key: str) -> DataFrame:
    """tp, fn, tn, fp of 0/1 targets and predictions per key; these sums add up over any partition of the rows."""
    y, p = F.col("y"), F.col("pred")
    one = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*key).agg(one((y == 1) & (p == 1)).alias("tp"), one((y == 1) & (p == 0)).alias("fn"), one((y == 0) & (p == 0)).alias("tn"), one((y == 0) & (p == 1)).alias("fp"))


def task_metrics(df: DataFrame, *key: str) -> DataFrame:
    """Balanced accuracy and macro F1 per key; targets must hold both classes, else both are null."""
    c = confusion(df, *key)
    args = [F.col(x) for x in ("tp", "fn", "tn", "fp")]
    ok = (args[0] + args[1] > 0) & (args[2] + args[3] > 0)
    return c.select(*key, F.when(ok, balanced(*args)).alias("balanced_accuracy"), F.when(ok, macro_f1(*args)).alias("macro_f1"))


def sample_metrics(df: DataFrame, sample: str, *key: str) -> DataFrame:
    """Per key: mean sample IoU (1 for an empty union), micro IoU, bit accuracy, Hamming loss and distance, exact match."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    rows = df.groupBy(*key, sample).agg(F.sum((y & p).cast("long")).alias("i"), F.sum((y | p).cast("long")).alias("u"), F.sum((y != p).cast("long")).alias("wrong"), F.count("*").alias("n"))
    iou = F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.col("u"))
    return rows.groupBy(*key).agg(F.avg(iou).alias("sample_iou"), (F.sum("i") / F.sum("u")).alias("micro_iou"), (1 - F.sum("wrong") / F.sum("n")).alias("bit_accuracy"), (F.sum("wrong") / F.sum("n")).alias("hamming_loss"), F.avg("wrong").alias("hamming_distance"), F.avg((F.col("wrong") == 0).cast("double")).alias("exact_match"))


def class_grid(df: DataFrame, classes: int, *key: str) -> DataFrame:
    """Counts of all target and predicted classes per key, zeros included."""
    counts = df.groupBy(*key, "y", "pred").agg(F.count("*").alias("n"))
    grid = counts.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("pred"))
    return grid.join(counts, [*key, "y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_metrics(df: DataFrame, classes: int, *key: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 (0 where undefined) of several classes per key."""
    g = class_grid(df, classes, *key)
    each = F.array(*(F.struct(
        F.sum(F.when((F.col("y") == c) & (F.col("pred") == c), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias("real"),
        F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias("said"),
    ) for c in range(classes)))
    a = g.groupBy(*key).agg(each.alias("c"), F.sum("n").alias("total"))
    add = lambda e: F.aggregate(F.transform("c", e), F.lit(0.0), lambda x, y: x + y)
    seen = F.size(F.filter("c", lambda s: s["real"] > 0))
    return a.select(*key, (add(lambda s: s["tp"].cast("double")) / F.col("total")).alias("accuracy"), (add(lambda s: safe_div(s["tp"].cast("double"), s["real"])) / seen).alias("balanced_accuracy"), (add(lambda s: safe_div(2.0 * s["tp"], s["real"] + s["said"])) / classes).alias("macro_f1"))


def brier(df: DataFrame, *key: str) -> DataFrame:
    """Mean squared difference of scores and targets per key."""
    d = F.col("score") - F.col("y")
    return df.groupBy(*key).agg(F.avg(d * d).alias("brier"))


def score_counts(df: DataFrame, *key: str) -> DataFrame:
    """Positives and negatives at each distinct score: what ranks need, after one combined aggregation."""
    return df.groupBy(*key, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


def roc_auc(df: DataFrame, *key: str) -> DataFrame:
    """Area under the ROC curve with ties, null for one class."""
    s = running_sums(score_counts(df, *key), key, ("score",), {"below": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return s.groupBy(*key).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), won / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, *key: str) -> DataFrame:
    """Sum of recall steps times precision from the highest score down."""
    s = running_sums(score_counts(df, *key), key, (F.desc("score"),), {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}, inclusive=True)
    return s.groupBy(*key).agg((F.sum(F.col("pos") * F.col("tp") / F.col("n")) / F.sum("pos")).alias("average_precision"))


def bin_of(score: Column, bins: int) -> Column:
    """Number of the equal bin of [0, 1] whose lower edge is the last at or below the score."""
    edges = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    at = F.size(F.filter(edges, lambda e: e <= score)) - 1
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))


def calibration_bins(df: DataFrame, bins: int, *key: str) -> DataFrame:
    return df.withColumn("bin", bin_of(F.col("score"), bins)).groupBy(*key, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))


def calibration_error(df: DataFrame, bins: int, *key: str) -> DataFrame:
    b = calibration_bins(df, bins, *key)
    return b.groupBy(*key).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))
