"""Wavelet power of single signals; each row's signal is convolved in Arrow batches, the rest is relational."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wavelet(freq: float, cycles: float, fs: float, zero_mean: bool) -> np.ndarray:
    """Complex Gaussian wavelet of a number of cycles, over plus and minus five deviations."""
    sigma = cycles / (2 * math.pi * freq)
    half = math.ceil(5 * sigma * fs) if not zero_mean else int(5 * sigma * fs)
    t = np.arange(-half, half + 1) / fs
    wave = np.exp(2j * math.pi * freq * t)
    if zero_mean:
        wave = wave - math.exp(-2 * (math.pi * freq * sigma) ** 2)
    wave = wave * np.exp(-(t**2) / (2 * sigma**2))
    return wave / (math.sqrt(0.5) * np.linalg.norm(wave)) if zero_mean else wave / np.abs(wave).sum()


#: Samples of signals that are transformed together.
SAMPLES = 1 << 20


def banked(sig: DataFrame, bank: list[tuple[float, list[tuple[np.ndarray, float]]]], edge: int, *key: str) -> DataFrame:
    """Weighted geometric mean of the powers of each frequency's wavelets, without `edge` samples at both ends.

    bank has (frequency, [(wavelet, weight)]). Signals of one length are transformed together, the wavelets once for
    each length; powers of a frequency's wavelets are summed as logarithms where they arise, so that what leaves the
    task is one array for each signal and frequency. Returns key, freq, t_idx, power.
    """
    rows = sig.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "x"))), lambda s: s["x"]).alias("x"))
    keys, longest = list(key), max(len(w) for _, waves in bank for w, _ in waves)

    def powers(x: np.ndarray, transforms: list[list[np.ndarray]], size: int) -> Iterator[tuple[float, np.ndarray]]:
        n = x.shape[1]
        spectrum = np.fft.fft(x, size, axis=1)
        for (freq, waves), known in zip(bank, transforms, strict=True):
            total = 0.0
            for (w, weight), t in zip(waves, known, strict=True):
                full = np.fft.ifft(spectrum * t, axis=1)[:, len(w) // 2 + edge : len(w) // 2 + n - edge]
                power = full.real**2 + full.imag**2
                total = power if len(waves) == 1 else total + weight * np.log(np.maximum(power, 1e-300))
            yield freq, total if len(waves) == 1 else np.exp(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transforms: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            x = batch.column("x")
            ends = x.offsets.to_numpy()
            lengths, values = np.diff(ends), x.values.to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                if n <= 2 * edge:
                    continue
                size = 1 << (n + longest).bit_length()
                if size not in transforms:
                    transforms[size] = [[np.fft.fft(w, size) for w, _ in waves] for _, waves in bank]
                own = np.flatnonzero(lengths == n)
                for k in range(0, len(own), max(1, SAMPLES // n)):
                    some = own[k : k + max(1, SAMPLES // n)]
                    signals = values[ends[some][:, None] + np.arange(n)]
                    cuts = pa.array(np.arange(len(some) + 1) * (n - 2 * edge), pa.int32())
                    for freq, power in powers(signals, transforms[size], size):
                        lists = pa.ListArray.from_arrays(cuts, pa.array(power.ravel()))
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in keys), pa.array(np.full(len(some), freq)), lists], names=[*keys, "freq", "power"])

    schema = ", ".join([*(f"{k} {sig.schema[k].dataType.simpleString()}" for k in keys), "freq double, power array<double>"])
    out = rows.mapInArrow(run, schema)
    return out.select(*keys, "freq", F.posexplode("power").alias("t", "power")).select(*keys, "freq", (F.col("t") + edge).alias("t_idx"), "power")


def morlet_power(sig: DataFrame, fs: float, freqs: list[float], *key: str, cycles: tuple[float, float] = (3.0, 10.0)) -> DataFrame:
    """Morlet power with f / 2 cycles within bounds; the longest wavelet's reach is trimmed at both ends."""
    bank = [(f, [(wavelet(f, min(max(f / 2, cycles[0]), cycles[1]), fs, True), 1.0)]) for f in freqs]
    return banked(sig, bank, max(len(waves[0][0]) for _, waves in bank) // 2, *key)


def superlet_power(sig: DataFrame, fs: float, freqs: list[float], orders: tuple[float, float], *key: str, base: float = 3.0, equal: bool = False) -> DataFrame:
    """Superlet power: weighted geometric mean over wavelets of 3, 6, 9, ... cycles.

    The order grows linearly with the frequency; order j has weight e = 1 / (order - lowest + 1) up to the whole part of
    the order and the remaining fraction of e above it, or equal weights.
    """
    lo, hi = orders
    bank = []
    for f in freqs:
        o = lo + (hi - lo) * (f - freqs[0]) / (freqs[-1] - freqs[0]) if len(freqs) > 1 else lo
        whole, part = int(math.floor(o)), o - math.floor(o)
        used = list(range(1, whole + 1 + (part > 0)))
        e = 1.0 / (o - lo + 1)
        weights = [1.0 / len(used) if equal else (e if j <= whole else part * e) for j in used]
        bank.append((f, [(wavelet(f, base * j, fs, False), w / sum(weights)) for j, w in zip(used, weights, strict=True)]))
    return banked(sig, bank, max(len(w) for _, waves in bank for w, _ in waves) // 2, *key)
