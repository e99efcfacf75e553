"""Feature scores, selection and scaling on long features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.columns import safe_div


def above_variance(features: DataFrame, t: float) -> DataFrame:
    return features.groupBy("feature").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > t)


def f_score(rows: DataFrame, *by: str) -> DataFrame:
    """One-way F of each feature over the classes y: undefined gives 0, no spread within classes the largest double."""
    c = rows.groupBy(*by, "feature", "y").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    a = c.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1), (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    f = F.when(F.col("k") < 2, 0.0).when(within > 0, between / within).when(between > 0, F.lit(1.7976931348623157e308)).otherwise(0.0)
    return a.select(*by, "feature", f.alias("f"))


def best_k(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k features with the largest score; equal scores in order of name."""
    w = Window.partitionBy(*by).orderBy(F.desc("f"), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multi_target_best(scores: DataFrame, k: int) -> DataFrame:
    """Rank per task to a percentile, mean over tasks, top k; scores has task, feature, f."""
    w = Window.partitionBy("task").orderBy(F.desc("f"), "feature")
    n = F.count("*").over(Window.partitionBy("task"))
    pct = scores.withColumn("pct", 1 - safe_div((F.row_number().over(w) - 1).cast("double"), n - 1))
    mean = pct.groupBy("feature").agg(F.avg("pct").alias("f"))
    return best_k(mean, k)


def standard_scale(train: DataFrame, rows: DataFrame) -> DataFrame:
    fit = train.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return rows.join(fit, "feature").withColumn("z", (F.col("value") - F.col("mu")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).drop("mu", "sd")
