"""Epoch shaping: crops, windows, bins and resampling over the sample index of long signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.columns import samples
from epochlake.operators.running import numbered

KEY = ("epoch_id", "channel")


def crop(sig: DataFrame, start_s: float, stop_s: float, fs: float) -> DataFrame:
    """Samples of the half-open range [start, stop) seconds."""
    a, b = samples(start_s, fs), samples(stop_s, fs)
    return sig.where((F.col("t_idx") >= a) & (F.col("t_idx") < b))


def windows(sig: DataFrame, n: int | Column, width: int, stride: int) -> DataFrame:
    """Complete sliding windows of n samples, a number or a column: each sample once for each window that holds it (win, w_idx)."""
    last = F.floor(((F.lit(n) if isinstance(n, int) else n) - width) / stride)
    lo = F.greatest(F.lit(0), F.ceil((F.col("t_idx") - width + 1) / stride)).cast("int")
    hi = F.least(last, F.floor(F.col("t_idx") / stride)).cast("int")
    fit = sig.where((lo <= hi) & (last >= 0)).withColumn("win", F.explode(F.sequence(lo, hi)))
    return fit.withColumn("w_idx", F.col("t_idx") - F.col("win") * stride)


def demean(sig: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return sig.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*key)))


def trim_and_bin(sig: DataFrame, n: int, edge: int, width: int, fs: float, key: tuple[str, ...] = KEY) -> DataFrame:
    """Means of complete bins, centred between two dropped edges: bin, t (bin centre in seconds), x."""
    room = n - 2 * edge
    bins = room // width
    first = edge + (room - bins * width) // 2
    b = F.floor((F.col("t_idx") - first) / width).cast("int")
    inside = sig.where((F.col("t_idx") >= first) & (F.col("t_idx") < first + bins * width)).withColumn("bin", b)
    return inside.groupBy(*key, "bin").agg(F.avg("x").alias("x")).withColumn("t", (first + F.col("bin") * width + (width - 1) / 2) / fs)


def every(sig: DataFrame, k: int) -> DataFrame:
    return sig.where(F.col("t_idx") % k == 0)


def interval_means(sig: DataFrame, bounds: list[tuple[float, float]], fs: float, n: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Mean in each half-open interval of seconds, rounded to samples and clamped: interval, x."""
    hits = [(k, max(0, round(a * fs)), min(n, round(b * fs))) for k, (a, b) in enumerate(bounds)]
    inside = F.filter(F.array(*(F.when((F.col("t_idx") >= a) & (F.col("t_idx") < b), F.lit(k)) for k, a, b in hits)), lambda v: v.isNotNull())
    return sig.withColumn("interval", F.explode(inside)).groupBy(*key, "interval").agg(F.avg("x").alias("x"))


def kaiser_taps(up: int, down: int) -> list[float]:
    """Low-pass taps of a polyphase resampler: windowed sinc, Kaiser beta 5, unit gain times up."""
    import numpy as np

    half = 10 * max(up, down)
    m = np.arange(-half, half + 1)
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * m) * np.kaiser(2 * half + 1, 5.0)
    return (h / h.sum() * up).tolist()


def resample(sig: DataFrame, n: int, fs_in: int, fs_out: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Polyphase resampling of n samples at fs_in to ceil(n * fs_out / fs_in) at fs_out; edges count as zero.

    Each sample goes to the outputs within the filter's reach and meets its tap there; the table of taps has a fixed
    size (20 * max(up, down) + 1), so it is a literal, and sums are combined before the shuffle.
    """
    g = math.gcd(fs_in, fs_out)
    up, down = fs_out // g, fs_in // g
    if up == down:
        return sig
    half, taps, last = 10 * max(up, down), kaiser_taps(up, down), -(-n * up // down) - 1
    lo = F.greatest(F.lit(0), F.ceil((F.col("t_idx") * up - half) / down)).cast("int")
    hi = F.least(F.lit(last), F.floor((F.col("t_idx") * up + half) / down)).cast("int")
    out = sig.where(lo <= hi).withColumn("m", F.explode(F.sequence(lo, hi)))
    tap = F.element_at(F.array(*map(F.lit, taps)), (F.lit(half + 1) + F.col("m") * down - F.col("t_idx") * up).cast("int"))
    return out.groupBy(*key, F.col("m").alias("t_idx")).agg(F.sum(F.col("x") * tap).alias("x"))


def pad_right(arrays: DataFrame, column: str, longest: Column) -> DataFrame:
    """Arrays padded with zeros to a common length, their own length, and the mask of real samples."""
    size, total = F.size(column), longest
    padded = F.concat(F.col(column), F.array_repeat(F.lit(0.0), (total - size).cast("int")))
    return arrays.withColumn("length", size.cast("long")).withColumn("mask", F.transform(F.sequence(F.lit(1), total.cast("int")), lambda i: i <= size)).withColumn(column, padded)


def batches(arrays: DataFrame, column: str, key: str, cells: int) -> DataFrame:
    """Arrays dealt to batches of like length, each padded to its own longest: batch (length class, number), padded, mask.

    A class holds lengths of as many binary digits, so that at most half of a batch is padding; its arrays are numbered in
    order of (length, key), and as many make a batch as have `cells` values together at the class's upper bound, one at
    least. Empty and null arrays make no batch. Numbers come from running sums over ranges; no class is sorted by one task.
    """
    rows = arrays.where(F.size(column) > 0).withColumn("length", F.size(column).cast("long"))
    rows = rows.withColumn("digits", F.length(F.bin("length")).cast("int"))
    rows = numbered(rows, ("digits",), ("length", key), "place")
    room = F.greatest(F.lit(1), F.floor(F.lit(float(cells)) / (F.pow(F.lit(2.0), F.col("digits")) - 1)))
    rows = rows.withColumn("number", F.floor(F.col("place") / room).cast("long"))
    longest = rows.groupBy("digits", "number").agg(F.max("length").alias("padded"))
    rows = rows.join(longest, ["digits", "number"])
    out = pad_right(rows.withColumn("own", F.col("length")).drop("length"), column, F.col("padded"))
    return out.withColumn("batch", F.struct("digits", "number")).drop("digits", "number", "place", "own")
