"""Audits of stored tables and scores, and baselines of scores, as functions of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.columns import flag


def of_pattern(df: DataFrame, kind: str, *types: str) -> DataFrame:
    """Rows whose pattern (a column) is one of some types; none named is an error."""
    if not types:
        raise ValueError("no pattern type")
    return df.where(F.col(kind).isin(*types))


def header_audit(df: DataFrame, source: str, size: str, *key: str) -> DataFrame:
    """Files and sources per key, and their shortest, longest and mean size."""
    return df.groupBy(*key).agg(F.count("*").alias("files"), F.count_distinct(source).alias("sources"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.avg(size).alias("mean"))


def paired(df: DataFrame, run: str, names: list[str], value: str, *key: str) -> DataFrame:
    """The value of each named run side by side per key, and whether all are equal; null where one is missing."""
    wide = df.groupBy(*key).pivot(run, names).agg(F.max(value))
    equal = F.lit(True)
    for n in names[1:]:
        equal = equal & (F.col(f"`{names[0]}`") == F.col(f"`{n}`"))
    return wide.withColumn("equal", equal)


def event_fraction(sig: DataFrame, event: Column, unit: tuple[str, ...], *key: str) -> DataFrame:
    """Per key the number of units, and the mean and the most of their shares of samples with an event (missing, small, ...)."""
    per = sig.groupBy(*unit, *key).agg(F.avg(event.cast("double")).alias("share"))
    return per.groupBy(*key).agg(F.count("*").alias("units"), F.avg("share").alias("mean"), F.max("share").alias("most"))


def sample_stratified(df: DataFrame, subject: str, trial: str, item: str, places: list[int]) -> DataFrame:
    """The first item of the subjects at some places of their order, from trials 1 and 2 in turn."""
    order = Window.orderBy(subject)  # a row for each subject
    chosen = df.select(subject).distinct().withColumn("place", F.dense_rank().over(order) - 1).where(F.col("place").isin(places))
    turn = F.create_map(*(F.lit(x) for k, p in enumerate(places) for x in (p, 1 + k % 2)))
    some = df.join(F.broadcast(chosen.limit(len(places))), subject).where(F.col(trial) == turn[F.col("place")])
    return some.groupBy(subject, trial).agg(F.min(item).alias(item))


def contract_violations(df: DataFrame, threshold: float, *key: str) -> DataFrame:
    """Rows, and those whose score isn't in [0, 1] or whose prediction isn't that of the threshold; nulls violate."""
    s = F.col("score")
    fine = s.between(0, 1) & (F.col("pred") == (s >= threshold).cast("int"))
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(flag(~F.coalesce(fine, F.lit(False)))).alias("violations"))


def one_class(df: DataFrame, *key: str) -> DataFrame:
    """Keys that lack a class."""
    g = df.groupBy(*key).agg(F.sum("y").alias("_p"), F.count("*").alias("_n"))
    return g.where("_p = 0 OR _p = _n").select(*key)


def leaders(df: DataFrame, name: str, metric: str, *key: str) -> DataFrame:
    """The name with the best metric per key, the first of equals; a null metric comes last."""
    top = df.groupBy(*key).agg(F.max(metric).alias("_top"))
    at = df.join(top, list(key)).where(F.col(metric).eqNullSafe(F.col("_top")))
    return at.groupBy(*key).agg(F.min(name).alias("leader"), F.max(metric).alias(metric))


def rate_scores(train: DataFrame, test: DataFrame, *key: str) -> DataFrame:
    """Test rows with the training rows' share of positives as score, over all rows or per key."""
    f = train.groupBy(*key).agg(F.avg("y").alias("score"))
    return test.drop("score").join(f, list(key)) if key else test.drop("score").crossJoin(F.broadcast(f))


def drawn_predictions(scored: DataFrame, seed: int, *row: str) -> DataFrame:
    """Rows with pred drawn with the chance in score, from the MD5 of the seed and the columns that name a row."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in row))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return scored.withColumn("pred", (u < F.col("score")).cast("int"))
