"""Spectra: Fourier transforms in Arrow batches; re-binning, bands, summaries, normalisation as relational algebra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.columns import safe_div


def hann(n: int) -> list[float]:
    import math

    return [0.5 - 0.5 * math.cos(2 * math.pi * k / n) for k in range(n)]


def periodogram(sig: DataFrame, n: int, fs: float, *key: str, at: str = "t_idx") -> DataFrame:
    """One-sided power density of windowed signals of n samples: key, k, freq, power; odd and even n.

    The samples of a signal are gathered once, a missing one counts as zero, and transformed in Arrow batches, so that
    neither samples nor frequencies are multiplied.
    """
    w = np.array(hann(n))
    scale = fs * float((w * w).sum())
    double = np.full(n // 2 + 1, 2.0)
    double[0] = 1.0
    if n % 2 == 0:
        double[-1] = 1.0
    whole = sig.groupBy(*key).agg(F.collect_list(F.struct(F.col(at).cast("int").alias("t"), F.col("x").cast("double").alias("x"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            t, x = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("t", "x"))
            inside = (t >= 0) & (t < n)
            dense = np.zeros((batch.num_rows, n))
            np.add.at(dense, (rows[inside], t[inside]), x[inside])
            power = np.abs(np.fft.rfft(dense * w, axis=1)) ** 2 / scale * double
            ends = pa.array(np.arange(batch.num_rows + 1) * power.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.ListArray.from_arrays(ends, pa.array(power.ravel()))], names=[*key, "p"])

    kinds = "".join(f"`{c}` {sig.schema[c].dataType.simpleString()}, " for c in key)
    found = whole.mapInArrow(run, f"{kinds}p array<double>").select(*key, F.posexplode("p").alias("k", "power"))
    return found.select(*key, "k", (F.col("k") * (fs / n)).alias("freq"), "power")


def frequency_grid(lo: float, hi: float, step: float) -> list[float]:
    """Inclusive grid whose last value is hi."""
    count = round((hi - lo) / step)
    return [lo + k * step for k in range(count)] + [hi]


def edges_of(centres: list[float]) -> list[float]:
    """Midpoints between bin centres, mirrored at both ends."""
    mid = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
    return [2 * centres[0] - mid[0], *mid, 2 * centres[-1] - mid[-1]]


def rebin(psd: DataFrame, native: list[float], target: list[float], *key: str) -> DataFrame:
    """Density re-binned to target centres by overlap of bins; an error unless the target is covered."""
    a, b = edges_of(native), edges_of(target)
    if b[0] < a[0] - 1e-12 or b[-1] > a[-1] + 1e-12:
        raise ValueError("native bins don't cover the target")
    shares = [(k, m, (min(a[k + 1], b[m + 1]) - max(a[k], b[m])) / (b[m + 1] - b[m])) for k in range(len(native)) for m in range(len(target)) if min(a[k + 1], b[m + 1]) - max(a[k], b[m]) > 1e-12]
    table = psd.sparkSession.createDataFrame([(k, m, target[m], s) for k, m, s in shares], "k int, m int, target double, share double")
    return psd.join(F.broadcast(table), "k").groupBy(*key, "m").agg(F.first("target").alias("freq"), F.sum(F.col("power") * F.col("share")).alias("power"))


def band_powers(psd: DataFrame, bands: dict[str, tuple[float, float]], bin_width: float, *key: str) -> DataFrame:
    """Absolute and relative power of bands by overlap of bins (centre plus or minus half a bin)."""
    lo, hi = F.col("freq") - bin_width / 2, F.col("freq") + bin_width / 2
    sums = [F.sum(F.col("power") * F.greatest(F.lit(0.0), F.least(hi, F.lit(b)) - F.greatest(lo, F.lit(a)))).alias(n) for n, (a, b) in bands.items()]
    first, last = min(a for a, _ in bands.values()), max(b for _, b in bands.values())
    total = F.sum(F.col("power") * F.greatest(F.lit(0.0), F.least(hi, F.lit(last)) - F.greatest(lo, F.lit(first)))).alias("total")
    wide = psd.groupBy(*key).agg(*sums, total)
    rows = F.array(*(F.struct(F.lit(n).alias("band"), F.col(n).alias("power"), safe_div(F.col(n), F.col("total")).alias("share")) for n in bands))
    return wide.select(*key, F.explode(rows).alias("r")).select(*key, "r.band", "r.power", "r.share")


def spectral_summary(psd: DataFrame, bins: int, *key: str) -> DataFrame:
    """Total power, dominant frequency (lowest among maxima), centroid, entropy over ln(bins)."""
    a = psd.groupBy(*key).agg(F.sum("power").alias("total"), F.min_by("freq", F.struct(-F.col("power"), F.col("freq"))).alias("top"), F.sum(F.col("freq") * F.col("power")).alias("weighted"), F.sum(F.when(F.col("power") > 0, F.col("power") * F.log("power")).otherwise(0.0)).alias("plogp"))
    import math

    entropy = F.when(F.col("total") > 0, (F.log("total") - F.col("plogp") / F.col("total")) / math.log(bins)).otherwise(0.0)
    return a.select(*key, F.col("total"), F.when(F.col("total") > 0, F.col("top")).otherwise(0.0).alias("dominant"), safe_div(F.col("weighted"), F.col("total")).alias("centroid"), entropy.alias("entropy"))


def trapezoid_bands(psd: DataFrame, bands: dict[str, tuple[float, float]], lo: float, hi: float, *key: str) -> DataFrame:
    """Trapezoid integral of each band (upper edge open but for the last) and its share of lo to hi."""
    w = Window.partitionBy(*key, "band").orderBy("freq")
    last = list(bands)[-1]
    inside = F.filter(F.array(*(F.when((F.col("freq") >= a) & ((F.col("freq") <= b) if n == last else (F.col("freq") < b)), F.lit(n)) for n, (a, b) in bands.items()), F.when((F.col("freq") >= lo) & (F.col("freq") <= hi), F.lit("#all"))), lambda v: v.isNotNull())
    p = psd.withColumn("band", F.explode(inside))
    area = (F.col("power") + F.lag("power").over(w)) / 2 * (F.col("freq") - F.lag("freq").over(w))
    sums = p.withColumn("area", area).groupBy(*key, "band").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("power"))
    total = F.max(F.when(F.col("band") == "#all", F.col("power"))).over(Window.partitionBy(*key))
    return sums.withColumn("total", total).where("band <> '#all'").select(*key, "band", "power", safe_div(F.col("power"), F.col("total")).alias("share"))


def log_zscore_fit(power: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Mean and scale of log power per frequency; scale 1 where the deviation is below 1e-6."""
    v = F.log(F.greatest(F.col("power"), F.lit(floor)))
    a = power.groupBy("k").agg(F.avg(v).alias("mu"), F.avg(v * v).alias("m2"))
    std = F.sqrt(F.greatest(F.col("m2") - F.col("mu") * F.col("mu"), F.lit(0.0)))
    return a.select("k", "mu", F.when(std < 1e-6, 1.0).otherwise(std).alias("scale"))


def log_zscore(power: DataFrame, fit: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Log power in units of the fitted frequencies, a table of one row per frequency bin."""
    v = F.log(F.greatest(F.col("power"), F.lit(floor)))
    return power.join(F.broadcast(fit), "k").withColumn("z", (v - F.col("mu")) / F.col("scale")).drop("mu", "scale")


def standardize(train: DataFrame, rows: DataFrame, value: Column, *cell: str, floor: float = 1e-6) -> DataFrame:
    """(value - mean) / max(std, floor) per cell, fitted on the training rows."""
    fit = train.withColumn("v", value).groupBy(*cell).agg(F.avg("v").alias("mu"), F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("scale"))
    return rows.withColumn("v", value).join(fit, list(cell)).withColumn("z", (F.col("v") - F.col("mu")) / F.col("scale")).drop("v", "mu", "scale")


def relative_to_peak(power: DataFrame, *key: str) -> DataFrame:
    return power.withColumn("relative", F.col("power") / F.max("power").over(Window.partitionBy(*key)))


def relative_db(power: DataFrame, floor: float, *key: str) -> DataFrame:
    peak = F.max("power").over(Window.partitionBy(*key))
    return power.withColumn("db", F.greatest(10 * F.log10(F.col("power") / peak), F.lit(float(floor))))
