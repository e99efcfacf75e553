"""Cross-channel matrices of long signals: shrunk covariance, correlation, matrix logarithm, spatial patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlake.operators.store import kept


def _covariances(sig: DataFrame, n: int, key: tuple[str, ...], finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Matrices of each key as rows (i, j, value): an epoch is gathered once, its products are taken where it lies."""
    cells = F.struct(F.col("ch_idx").cast("int").alias("c"), F.col("t_idx").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
    whole = sig.groupBy(*key).agg(F.collect_list(cells).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            c, t, x = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("c", "t", "x"))
            rows, left, right, value = [], [], [], []
            for k in range(batch.num_rows):
                part = slice(ends[k], ends[k + 1])
                channels, row = np.unique(c[part], return_inverse=True)
                times, col = np.unique(t[part], return_inverse=True)
                m, seen = np.zeros((len(channels), len(times))), np.zeros((len(channels), len(times)), dtype=bool)
                m[row, col], seen[row, col] = x[part], True
                m = np.where(seen, m - m.sum(axis=1, keepdims=True) / seen.sum(axis=1, keepdims=True), 0.0)
                cov = finish(m @ m.T / n)
                rows.append(np.full(cov.size, k))
                left.append(np.repeat(channels, len(channels)))
                right.append(np.tile(channels, len(channels)))
                value.append(cov.ravel())
            if rows:
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(f).take(of) for f in key), pa.array(np.concatenate(left).astype(np.int32)), pa.array(np.concatenate(right).astype(np.int32)), pa.array(np.concatenate(value))], names=[*key, "i", "j", "value"])

    kinds = "".join(f"`{f}` {sig.schema[f].dataType.simpleString()}, " for f in key)
    return whole.mapInArrow(run, f"{kinds}i int, j int, value double")


def empirical(sig: DataFrame, n: int, *key: str) -> DataFrame:
    """Covariance over n samples per key: i, j, value for all channel pairs; a missing sample adds nothing."""
    return _covariances(sig, n, key, lambda c: c)


def covariance(sig: DataFrame, channels: int, n: int, *key: str) -> DataFrame:
    """Covariance with oracle approximating shrinkage towards mean variance; constant signals give zeros."""

    def shrunk(c: np.ndarray) -> np.ndarray:
        mu, alpha = np.trace(c) / channels, (c * c).mean()
        below = (n + 1) * (alpha - mu * mu / channels)
        s = min(1.0, (alpha + mu * mu) / below) if below > 0 else 1.0
        return (1 - s) * c + s * mu * np.eye(len(c))

    return _covariances(sig, n, key, shrunk)


def correlation(cov: DataFrame, *key: str) -> DataFrame:
    """Covariance over the outer product of deviations, within -1 and 1; the diagonal is 1 where the variance isn't 0."""
    w = Window.partitionBy(*key)
    by = F.map_from_entries(F.collect_list(F.when(F.col("i") == F.col("j"), F.struct("i", "value"))).over(w))
    c = cov.withColumn("by", by)
    scale = F.sqrt(F.element_at("by", F.col("i")) * F.element_at("by", F.col("j")))
    r = F.when(scale > 0, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / scale)))).otherwise(0.0)
    return c.select(*key, "i", "j", r.alias("value"))


def matrices(cov: DataFrame, channels: int, *key: str) -> DataFrame:
    """One row per key with the matrix as an array in row order."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "value")))
    return cov.groupBy(*key).agg(F.transform(cells, lambda s: s["value"]).alias("m"))


def _log(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    top = values.max(axis=-1, keepdims=True)
    safe = np.log(np.maximum(values, np.where(top > 0, 1e-12 * top, 1.0)))
    out = np.einsum("nij,nj,nkj->nik", vectors, safe, vectors)
    out[top[:, 0] <= 0] = 0.0
    return out


def _mapped(rows: DataFrame, channels: int, kernel, *key: str) -> DataFrame:
    """kernel on batches of matrices, back in long form."""
    keys = list(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = kernel(b.column("m").flatten().to_numpy(zero_copy_only=False).reshape(-1, channels, channels))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * channels * channels, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists], names=[*keys, "m"])

    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "m array<double>"])
    out = rows.select(*keys, "m").mapInArrow(run, schema)
    return out.select(*keys, F.posexplode("m").alias("p", "value")).select(*keys, F.floor(F.col("p") / channels).cast("int").alias("i"), (F.col("p") % channels).alias("j"), "value")


def log_covariance(cov: DataFrame, channels: int, *key: str) -> DataFrame:
    """Matrix logarithm with eigenvalues floored at 1e-12 of the largest; zero matrices stay zero."""
    return _mapped(matrices(cov, channels, *key), channels, _log, *key)


#: Matrices taken together, and rows to which partial sums of partitions are brought before the driver adds them.
TOGETHER, SHARES = 1024, 64

Partial = tuple[int, np.ndarray]


def _summed(rows: DataFrame, channels: int, part, join) -> Partial:  # noqa: ANN001
    """Count and matrix of all rows: part makes them of some matrices, join of two of them.

    Every partition sends one matrix, those of many partitions are joined in Spark first, and the driver joins at most
    64 of channels squared numbers.
    """
    to_arrow = pa.schema([("share", pa.int32()), ("n", pa.int64()), ("m", pa.list_(pa.float64()))])
    kind = "share int, n long, m array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, share = None, 0
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                own = b.slice(k, TOGETHER)
                share = own.column("share")[0].as_py()
                m = own.column("m").flatten().to_numpy(zero_copy_only=False).reshape(-1, channels, channels)
                new = len(m), part(m)
                held = new if held is None else join(held, new)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"share": share, "n": held[0], "m": held[1].ravel()}], schema=to_arrow)

    def joined(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for k in range(b.num_rows):
                new = b.column("n")[k].as_py(), b.column("m")[k].values.to_numpy().reshape(channels, channels)
                held = new if held is None else join(held, new)
        yield pa.RecordBatch.from_pylist([{"share": key[0].as_py(), "n": held[0], "m": held[1].ravel()}], schema=to_arrow)

    parts = rows.select("m", (F.spark_partition_id() % SHARES).alias("share")).mapInArrow(run, kind)
    held: Partial | None = None
    for r in parts.groupBy("share").applyInArrow(joined, kind).orderBy("share").collect():
        new = r["n"], np.array(r["m"]).reshape(channels, channels)
        held = new if held is None else join(held, new)
    if held is None:
        raise ValueError("no matrices")
    return held


def _add(a: Partial, b: Partial) -> Partial:
    return a[0] + b[0], a[1] + b[1]


def mean_matrix(rows: DataFrame, channels: int) -> np.ndarray:
    """Mean of matrices, channels squared numbers whatever the number of rows."""
    n, total = _summed(rows, channels, lambda m: m.sum(axis=0), _add)
    return total / n


def tangent_space(cov: DataFrame, channels: int, train: Column, *key: str) -> DataFrame:
    """Logarithm of each matrix at the log-Euclidean mean of the training matrices: log(M^-1/2 C M^-1/2)."""
    rows = kept(matrices(cov, channels, *key))
    n, total = _summed(rows.where(train), channels, lambda m: _log(m).sum(axis=0), _add)
    values, vectors = np.linalg.eigh(total / n)
    white = vectors @ np.diag(np.exp(-values / 2)) @ vectors.T
    return _mapped(rows, channels, lambda m: _log(white @ m @ white), *key)


def _power(m: np.ndarray, by: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return vectors @ np.diag(np.maximum(values, 1e-12 * values.max()) ** by) @ vectors.T


def _moved(mean: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where the geodesic from mean in the direction of step ends."""
    values, vectors = np.linalg.eigh(step)
    root = _power(mean, 0.5)
    return root @ (vectors @ np.diag(np.exp(values)) @ vectors.T) @ root


def _logs_at(mean: np.ndarray, m: np.ndarray) -> np.ndarray:
    white = _power(mean, -0.5)
    return _log(white @ m @ white)


def _between(a: Partial, b: Partial) -> Partial:
    """The weighted point on the geodesic from one mean to another."""
    n = a[0] + b[0]
    return n, _moved(a[1], _logs_at(a[1], b[1][None])[0] * (b[0] / n))


def _near_mean(m: np.ndarray) -> np.ndarray:
    mean = m.mean(axis=0)
    for _ in range(3):
        mean = _moved(mean, _logs_at(mean, m).mean(axis=0))
    return mean


def riemannian_mean(rows: DataFrame, channels: int, rounds: int = 20, tol: float = 1e-9) -> np.ndarray:
    """Affine-invariant mean of stored positive matrices (m): the place where the logarithms of all average to zero.

    The means of portions, joined along geodesics by their weights, are the start, so that few exact rounds are left;
    each of these averages log(M^-1/2 C M^-1/2) over all matrices in one pass.
    """
    _, mean = _summed(rows, channels, _near_mean, _between)
    for _ in range(rounds):
        n, total = _summed(rows, channels, lambda m, mean=mean: _logs_at(mean, m).sum(axis=0), _add)
        mean = _moved(mean, total / n)
        if np.linalg.norm(total / n) < tol:
            break
    return mean


def riemannian_tangent(cov: DataFrame, channels: int, train: Column, *key: str) -> DataFrame:
    """Logarithm of each matrix at the affine-invariant mean of the training matrices; they are made once and stored."""
    rows = kept(matrices(cov, channels, *key))
    white = _power(riemannian_mean(rows.where(train), channels), -0.5)
    return _mapped(rows, channels, lambda m: _log(white @ m @ white), *key)


def xdawn_covariances(sig: DataFrame, channels: int, n: int, filters: int, train: Column) -> tuple[DataFrame, int]:
    """Shrunk covariances of filtered epochs joined to filtered class templates, and their number of channels.

    sig has epoch_id, y, ch_idx, t_idx, x. A class's template is the average of its training epochs; its filters
    enhance the template against the training signals (generalised eigenproblem of channel size, solved here). The
    templates seen through their filters are put beside every epoch seen through all filters, as in ERP covariances.
    """
    known = sig.where(train)
    templates = known.groupBy("y", "ch_idx", "t_idx").agg(F.avg("x").alias("x")).orderBy("y", "ch_idx", "t_idx").collect()  # classes * channels * n cells
    classes = sorted({r["y"] for r in templates})
    evoked = {y: np.zeros((channels, n)) for y in classes}
    for r in templates:
        evoked[r["y"]][r["ch_idx"], r["t_idx"]] = r["x"]
    noise = mean_matrix(matrices(empirical(known, n, "epoch_id"), channels, "epoch_id"), channels)
    white = _power(noise, -0.5)
    bank = []
    for y in classes:
        e = evoked[y] - evoked[y].mean(axis=1, keepdims=True)
        values, vectors = np.linalg.eigh(white @ (e @ e.T / n) @ white)
        bank.append((white @ vectors[:, np.argsort(-values, kind="stable")[:filters]]).T)
    prototypes = np.concatenate([f @ evoked[y] for y, f in zip(classes, bank, strict=True)])
    bank_rows = np.concatenate(bank)
    half = len(bank_rows)
    weights = sig.sparkSession.createDataFrame([(k, c, float(v)) for k, f in enumerate(bank_rows) for c, v in enumerate(f)], "f int, ch_idx int, w double")
    seen = sig.join(F.broadcast(weights), "ch_idx").groupBy("epoch_id", "t_idx", (F.col("f") + half).alias("f")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    fixed = sig.sparkSession.createDataFrame([(k, t, float(v)) for k, p in enumerate(prototypes) for t, v in enumerate(p)], "f int, t_idx int, x double")
    beside = sig.select("epoch_id").distinct().crossJoin(F.broadcast(fixed)).select("epoch_id", "t_idx", "f", "x")
    joined = seen.select("epoch_id", "t_idx", "f", "x").unionByName(beside).withColumnRenamed("f", "ch_idx")
    return covariance(joined, 2 * half, n, "epoch_id"), 2 * half


def csp_features(sig: DataFrame, channels: int, n: int, components: int, train: Column) -> DataFrame:
    """Common spatial patterns of two classes: log power of each epoch along filters that separate them most.

    Class covariances are averaged in Spark; the eigenproblem has the size of the channels and is solved here.
    """
    cov = empirical(sig, n, "epoch_id", "y")
    stored = kept(matrices(cov, channels, "epoch_id", "y"))
    fit = stored.where(train)
    a, b = (mean_matrix(fit.where(F.col("y") == c), channels) for c in (0, 1))
    values, vectors = np.linalg.eigh(a + b)
    white = vectors / np.sqrt(np.maximum(values, 1e-12 * values.max()))
    share, turn = np.linalg.eigh(white.T @ a @ white)
    filters = (white @ turn)[:, np.argsort(-np.abs(share - 0.5), kind="stable")[:components]].T
    weights = F.array(*(F.array(*(F.lit(float(w)) for w in f)) for f in filters))
    rows = stored.select("epoch_id", "m", F.posexplode(weights).alias("component", "w"))
    power = F.aggregate(F.sequence(F.lit(0), F.lit(channels * channels - 1)), F.lit(0.0), lambda acc, p: acc + F.element_at("m", p + 1) * F.element_at("w", F.floor(p / channels).cast("int") + 1) * F.element_at("w", p % channels + 1))
    return rows.select("epoch_id", "component", F.log(F.greatest(power, F.lit(1e-300))).alias("value"))
