"""Per-channel features of long signals: time features, local patterns, histograms, naming and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.columns import safe_div

#: The thirteen time features in order.
TIME_FEATURES = ("mean", "variance", "std", "rms", "median", "mad", "peak_to_peak", "skewness", "kurtosis", "line_length", "zero_crossing_rate", "mobility", "complexity")


def time_features(sig: DataFrame, *key: str) -> DataFrame:
    """The thirteen time features of each signal, one row per key; signals need three samples or more.

    One window pass makes first and second differences, one aggregation makes moments, order statistics and
    Hjorth terms, and the median deviation comes from the sorted values of the same group.
    """
    w = Window.partitionBy(*key).orderBy("t_idx")
    d = sig.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("d2", F.col("x") - 2 * F.lag("x").over(w) + F.lag("x", 2).over(w))
    d = d.withColumn("crossed", ((F.col("x") < 0) != (F.lag("x").over(w) < 0)).cast("double"))
    a = d.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.percentile("x", 0.5).alias("median"), F.collect_list("x").alias("xs"), (F.max("x") - F.min("x")).alias("peak_to_peak"),
        F.coalesce(F.skewness("x"), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis("x"), F.lit(0.0)).alias("kurtosis"),
        F.avg(F.abs("dx")).alias("line_length"), F.avg("crossed").alias("zero_crossing_rate"), F.var_pop("dx").alias("v1"), F.var_pop("d2").alias("v2"),
    )
    dev = F.array_sort(F.transform("xs", lambda v: F.abs(v - F.col("median"))))
    size = F.size("xs")
    mad = (F.element_at(dev, F.floor((size + 1) / 2).cast("int")) + F.element_at(dev, F.floor(size / 2 + 1).cast("int"))) / 2
    mobility = F.sqrt(safe_div(F.col("v1"), F.col("variance")))
    complexity = safe_div(F.sqrt(safe_div(F.col("v2"), F.col("v1"))), mobility)
    return a.where("n >= 3").select(*key, "mean", "variance", F.sqrt("variance").alias("std"), "rms", "median", mad.alias("mad"), "peak_to_peak", "skewness", "kurtosis", "line_length", "zero_crossing_rate", mobility.alias("mobility"), complexity.alias("complexity"))


def _code(bits: Column) -> Column:
    """The number whose bits are given, the most significant first."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))


KINDS = ("lndp", "lgp", "lbp")


def _bits(kind: str, run: Column, m: int) -> Column:
    half = m // 2
    centre = F.element_at(run, half + 1)
    around = F.concat(F.slice(run, 1, half), F.slice(run, half + 2, half))
    if kind == "lndp":
        return F.zip_with(F.slice(run, 2, m), F.slice(run, 1, m), lambda b, a: b >= a)
    if kind == "lgp":
        distance = F.transform(around, lambda v: F.abs(v - centre))
        mean = F.aggregate(distance, F.lit(0.0), lambda a, b: a + b) / m
        return F.transform(distance, lambda g: g >= mean)
    if kind == "lbp":
        return F.transform(around, lambda v: v >= centre)
    raise ValueError(f"no pattern {kind}")


def neighbourhoods(sig: DataFrame, m: int, *key: str) -> DataFrame:
    """Windows of m + 1 samples around a centre as arrays `run`, an even m; t_idx is the window's first sample."""
    if m % 2 or m < 2:
        raise ValueError("the number of neighbours must be even")
    w = Window.partitionBy(*key).orderBy("t_idx").rowsBetween(0, m)
    return sig.withColumn("run", F.collect_list("x").over(w)).where(F.size("run") == m + 1)


def pattern_codes(sig: DataFrame, m: int, kind: str, *key: str) -> DataFrame:
    """Codes of windows of m + 1 samples around a centre, an even m; bit zero belongs to the last neighbour.

    lndp: differences of neighbours that don't fall; lgp: distances from the centre of at least their mean; lbp: neighbours
    of at least the centre. t_idx is the window's first sample; a signal of n samples has n - m codes.
    """
    return neighbourhoods(sig, m, *key).select(*key, "t_idx", _code(_bits(kind, F.col("run"), m)).alias("code"))


def code_histogram(codes: DataFrame, m: int, *key: str, share: bool = True) -> DataFrame:
    """Counts or shares of all 2^m codes of each key, zeros included."""
    counts = codes.groupBy(*key, "code").agg(F.count("*").alias("c"))
    per = counts.groupBy(*key).agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("code", "c"))).alias("by"))
    full = per.select(*key, "total", "by", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**m - 1).cast("long"))).alias("code"))
    c = F.coalesce(F.element_at("by", F.col("code")), F.lit(0).cast("long"))
    return full.select(*key, "code", (c / F.col("total") if share else c).alias("value"))


def local_patterns(sig: DataFrame, m: int, *key: str) -> DataFrame:
    """Histogram shares of the three families, named by family and zero-padded code; one pass over the signal."""
    digits = len(str(2**m - 1))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), _code(_bits(k, F.col("run"), m)).alias("code")) for k in KINDS))
    codes = neighbourhoods(sig, m, *key).select(*key, F.explode(kinds).alias("c")).select(*key, "c.kind", "c.code")
    name = F.concat("kind", F.lit(":code_"), F.lpad(F.col("code").cast("string"), digits, "0"))
    return code_histogram(codes, m, *key, "kind").select(*key, name.alias("feature"), "value")


def long_form(wide: DataFrame, *key: str, block: str = "time") -> DataFrame:
    """Features in rows: key, block, feature, ordinal, value."""
    names = [c for c in wide.columns if c not in key]
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(k).alias("ordinal"), F.col(c).cast("double").alias("value")) for k, c in enumerate(names)))
    return wide.select(*key, F.lit(block).alias("block"), F.explode(pairs).alias("p")).select(*key, "block", "p.feature", "p.ordinal", "p.value")


def flatten_symmetric(matrix: DataFrame, channels: int, *key: str) -> DataFrame:
    """Upper triangles of symmetric matrices (i, j, value), off-diagonal values times the root of two, in row order."""
    i, j = F.col("i"), F.col("j")
    ordinal = i * channels - F.floor(i * (i - 1) / 2) + (j - i) if channels else i
    return matrix.where(i <= j).select(*key, ordinal.cast("int").alias("ordinal"), (F.col("value") * F.when(i < j, F.sqrt(F.lit(2.0))).otherwise(1.0)).alias("value"))


def select_blocks(features: DataFrame, names: list[str]) -> DataFrame:
    """Blocks in the given order; a block that nothing has is an error."""
    known = {r[0] for r in features.where(F.col("block").isin(names)).select("block").distinct().collect()}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown blocks: {missing}")
    order = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))))
    return features.where(F.col("block").isin(names)).withColumn("block_order", order[F.col("block")])


def feature_matrix(features: DataFrame, *key: str) -> DataFrame:
    """One row per key: names and values in ordinal order; keys whose names differ are an error elsewhere (see V5)."""
    pairs = F.array_sort(F.collect_list(F.struct("block", "ordinal", "feature", "value")))
    return features.groupBy(*key).agg(pairs.alias("p")).select(*key, F.transform("p", lambda s: s["feature"]).alias("names"), F.transform("p", lambda s: s["value"]).alias("features"))


def top_codes(histogram: DataFrame, k: int, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("value"), "code")
    return histogram.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
