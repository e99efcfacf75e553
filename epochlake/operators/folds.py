"""Linear models over folds and grids from one pass: centred moments of every fold, merged, and fits of all candidates.

Rows have fold (int), x (array of features), y (array of targets) and, if they stand for several equal ones, their number
times; a row with a null, a NaN or an infinity is left out. A fold's training moments are those of the other folds merged, so that the rows are read once for all folds,
feature families, penalties and component counts, and once more to score them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.operators.store import kept

#: Rows taken together, side of the blocks in which moments are moved, most bytes of moments in a task and of weights.
ROWS, BLOCK = 1024, 256
MOST_BYTES = 1 << 30
#: Training set of all folds.
ALL = -1


@dataclass(frozen=True)
class Candidate:
    """A model of a grid: "ridge" (alpha), "pls" (components) or "elastic" (alpha and its share l1 of absolute values).

    features names a family by places (None: all); of those with variance the k best by F score are taken, scaled to unit
    variance. together chooses them for all targets at once, by mean percentile of their ranks, else for each target.
    """

    model: str
    k: int
    features: tuple[int, ...] | None = None
    alpha: float = 1.0
    components: int = 2
    l1: float = 0.5
    together: bool = False


Moments = tuple[int, np.ndarray, np.ndarray]


def merged(a: Moments | None, b: Moments) -> Moments:
    """Row count, means and centred products of two sets of rows together."""
    if a is None or not a[0]:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whole_rows(rows: DataFrame, k: int, m: int) -> DataFrame:
    """Rows of k finite features and m finite targets."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = lambda c, n: (F.size(c) == n) & ~F.exists(c, bad)
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    return rows.select(F.col("fold").cast("int").alias("fold"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), times.cast("double").alias("times")).where(F.col("fold").isNotNull() & fine("x", k) & fine("y", m))


def counted(rows: DataFrame) -> DataFrame:
    """Whole rows, equal ones as one with their number, spread over tasks: what is read many times is read shortened."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy("fold", "x", "y").agg(F.sum("times").alias("times")).repartition(n)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Folds, features, targets and numbers of some rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y"))
            x, y = (v.reshape(part.num_rows, len(v) // part.num_rows) for v in (x, y))
            yield part.column("fold").to_numpy(), x, y, part.column("times").to_numpy()


def spread(rows: DataFrame) -> DataFrame:
    """Not many more partitions than cores: every task sends moments, whose size doesn't follow its rows."""
    return rows.coalesce(max(1, 4 * rows.sparkSession.sparkContext.defaultParallelism))


def fold_moments(rows: DataFrame, k: int, m: int, folds: int, block: int = BLOCK) -> DataFrame:
    """Moments of k features and m targets together for each fold, in blocks: fold, i, j, n, means a and b, products c.

    A task adds up whole matrices and sends those blocks on or above the diagonal; a block's parts are merged one by one
    as they arrive. Means are taken out in each portion of rows, so that nothing is lost to large offsets.
    """
    size = k + m
    if size * size * 8 * folds > MOST_BYTES:
        raise ValueError(f"{folds} folds of {size} columns have more than {MOST_BYTES} bytes of moments")
    kind = "fold int, i int, j int, n long, a array<double>, b array<double>, c array<double>"
    cuts = [(s, min(s + block, size)) for s in range(0, size, block)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for fold, x, y, times in matrices(batches):
            z = np.hstack((x, y))
            for f in np.unique(fold).tolist():
                own, each = z[fold == f], times[fold == f]
                mean = each @ own / each.sum()
                own = own - mean
                held[f] = merged(held.get(f), (int(each.sum()), mean, (own * each[:, None]).T @ own))
        for f, (n, mean, c) in held.items():
            for i, (a, b) in enumerate(cuts):
                for j, (d, e) in enumerate(cuts[i:], start=i):
                    yield pa.RecordBatch.from_pylist([{"fold": f, "i": i, "j": j, "n": n, "a": mean[a:b], "b": mean[d:e], "c": c[a:b, d:e].ravel()}], schema=to_arrow)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b, c = 0, 0.0, 0.0, 0.0
        for batch in batches:
            for r in range(batch.num_rows):
                more, d, e, g = batch.column("n")[r].as_py(), *(batch.column(x)[r].values.to_numpy() for x in "abc")
                if n:
                    c = c + g + np.outer(d - a, e - b).ravel() * (n * more / (n + more))
                    a, b = a + (d - a) * (more / (n + more)), b + (e - b) * (more / (n + more))
                else:
                    a, b, c = d, e, g
                n += more
        yield pa.RecordBatch.from_pylist([{**{x: v.as_py() for x, v in zip(("fold", "i", "j"), key, strict=True)}, "n": n, "a": a, "b": b, "c": c}], schema=to_arrow)

    doubles = pa.list_(pa.float64())
    to_arrow = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("a", doubles), ("b", doubles), ("c", doubles)])
    return spread(whole_rows(rows, k, m)).mapInArrow(part, kind).groupBy("fold", "i", "j").applyInArrow(merge, kind)


def assembled(table: pa.Table, size: int, block: int) -> Moments:
    """The moments of all folds in a table of blocks."""
    by: dict[int, Moments] = {}
    for r in range(table.num_rows):
        f, i, j, n = (table.column(c)[r].as_py() for c in ("fold", "i", "j", "n"))
        a, b, c = (table.column(x)[r].values.to_numpy() for x in "abc")
        if f not in by:
            by[f] = n, np.zeros(size), np.zeros((size, size))
        _, mean, whole = by[f]
        p, q = i * block, j * block
        mean[p : p + len(a)], mean[q : q + len(b)] = a, b
        whole[p : p + len(a), q : q + len(b)] = c.reshape(len(a), len(b))
        whole[q : q + len(b), p : p + len(a)] = c.reshape(len(a), len(b)).T
    out: Moments | None = None
    for f in sorted(by):
        out = merged(out, by[f])
    return out


def collected(df: DataFrame, columns: list[str], fold: str | None = None) -> dict[int, Moments]:
    """Moments of the columns by fold (0 without one) on the driver, from one pass; rows with a null or NaN are left out."""
    number = F.lit(0) if fold is None else F.col(fold)
    rows = df.select(number.cast("int").alias("fold"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.array().cast("array<double>").alias("y"))
    folds = 1 if fold is None else rows.select(F.count_distinct("fold")).first()[0]
    table = fold_moments(rows, len(columns), 0, max(folds, 1)).toArrow()
    at = table.column("fold").to_numpy()
    return {int(f): assembled(table.filter(pa.array(at == f)), len(columns), BLOCK) for f in np.unique(at)}


def f_scores(n: int, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """F of each feature (rows) over the two classes of each target: undefined gives 0, no spread within the largest double."""
    between = np.divide(xy * xy, yy[None, :], out=np.zeros_like(xy), where=yy[None, :] > 0)
    within = np.maximum(xx[:, None] - between, 0.0) / max(n - 2, 1)
    within[within <= 1e-14 * xx[:, None]] = 0.0
    out = np.divide(between, within, out=np.zeros_like(xy), where=within > 0)
    return np.where((within == 0) & (between > 0), np.finfo(np.float64).max, out)


def best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of the k largest scores among some features; equal scores in order of place."""
    order = among[np.lexsort((among, -scores[among]))]
    return np.sort(order[:k])


def percentiles(scores: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Mean over targets of each feature's rank, as 1 for the first down to 0 for the last."""
    out = np.zeros(len(scores))
    for t in range(scores.shape[1]):
        order = among[np.lexsort((among, -scores[among, t]))]
        out[order] += 1 - np.arange(len(order)) / max(len(order) - 1, 1)
    return out / scores.shape[1]


def elastic_weights(r: np.ndarray, c: np.ndarray, alpha: float, l1: float, rounds: int = 10_000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of a penalised least squares from products over n of scaled features, coordinate by coordinate."""
    w = np.zeros_like(c)
    for t in range(c.shape[1]):
        v, left = np.zeros(len(c)), c[:, t].copy()
        for _ in range(rounds):
            most = 0.0
            for j in range(len(c)):
                had = v[j]
                rho = left[j] + r[j, j] * had
                v[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (r[j, j] + alpha * (1 - l1))
                if v[j] != had:
                    left -= r[:, j] * (v[j] - had)
                    most = max(most, abs(v[j] - had))
            if most <= tolerance:
                break
        w[:, t] = v
    return w


def pls_weights(r: np.ndarray, c: np.ndarray, components: int) -> list[np.ndarray]:
    """Weights with 1, 2, ... components, from products of features and of features with targets (kernel form)."""
    left, rotations, loadings, out, total = c.copy(), [], [], [], np.zeros_like(c)
    for _ in range(min(components, len(c))):
        _, vectors = np.linalg.eigh(left.T @ left)
        w = left @ vectors[:, -1]
        if not np.linalg.norm(w) > 1e-12 * max(np.linalg.norm(c), 1e-300):
            break
        w /= np.linalg.norm(w)
        rotation = w.copy()
        for p, before in zip(loadings, rotations, strict=True):
            rotation -= (p @ w) * before
        spread_ = rotation @ r @ rotation
        p, q = r @ rotation / spread_, left.T @ rotation / spread_
        left -= np.outer(p, q) * spread_
        rotations.append(rotation)
        loadings.append(p)
        total = total + np.outer(rotation, q)
        out.append(total)
    return out or [total]


class Fits:
    """All candidates' weights from the moments of one training set; what candidates share is computed once."""

    def __init__(self, moments: Moments, k: int):
        self.n, self.mean, c = moments
        self.k, self.xx, self.xy = k, c[:k, :k], c[:k, k:]
        self.var, yy = np.diag(self.xx) / self.n, np.maximum(np.diag(c)[k:], 0.0)
        self.var = np.where(self.var > 1e-28 * self.mean[:k] ** 2, self.var, 0.0)  # less is the rounding of a constant
        self.scores = f_scores(self.n, np.diag(self.xx), self.xy, yy)
        self.known: dict[tuple, object] = {}

    def once(self, key: tuple, make):  # noqa: ANN001, ANN202
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def chosen(self, c: Candidate, task: int | None) -> np.ndarray:
        among = np.arange(self.k) if c.features is None else np.array(sorted(c.features))
        among = among[self.var[among] > 0]
        scores = self.once(("percentiles", c.features), lambda: percentiles(self.scores, among)) if task is None else self.scores[:, task]
        return best(scores, among, c.k)

    def weights(self, c: Candidate) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights (features x targets) and intercepts on the features' own scale, and the number of features of each target."""
        w, used = np.zeros_like(self.xy), np.zeros(self.xy.shape[1], dtype=np.int64)
        for tasks in [None] if c.together else range(self.xy.shape[1]):
            at = self.chosen(c, tasks)
            columns = slice(None) if tasks is None else slice(tasks, tasks + 1)
            used[columns] = len(at)
            if len(at):
                scale = np.sqrt(self.var[at])
                key = (tuple(at.tolist()), tasks)
                r = self.once(("r", *key), lambda: self.xx[np.ix_(at, at)] / np.outer(scale, scale))  # noqa: B023
                w[at, columns] = self.solved(c, key, r, self.xy[at, columns] / scale[:, None]) / scale[:, None]
        return w, self.mean[self.k :] - self.mean[: self.k] @ w, used

    def solved(self, c: Candidate, key: tuple, r: np.ndarray, xy: np.ndarray) -> np.ndarray:
        if c.model == "ridge":
            values, vectors = self.once(("eigen", *key), lambda: np.linalg.eigh(r))
            return vectors @ ((vectors.T @ xy) / (values[:, None] + c.alpha))
        if c.model == "pls":
            found = self.once(("pls", *key), lambda: pls_weights(r, xy, 64))
            return found[min(c.components, len(found)) - 1]
        if c.model == "elastic":
            return elastic_weights(r / self.n, xy / self.n, c.alpha, c.l1)
        raise ValueError(f"no model {c.model}")


def fits(moments: DataFrame, k: int, m: int, folds: list[int], grid: list[Candidate], block: int = BLOCK) -> DataFrame:
    """Weights of every candidate without each fold, and with all (held = -1): held, candidate, task, weights, intercept, used.

    The training sets are fitted each in a task of its own from the blocks of their folds.
    """
    kind = "held int, candidate int, task int, weights array<double>, intercept double, used long"

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        own = Fits(assembled(table, k + m, block), k)
        rows = []
        for g, c in enumerate(grid):
            w, b, used = own.weights(c)
            rows += [{"held": key[0].as_py(), "candidate": g, "task": t, "weights": w[:, t], "intercept": b[t], "used": int(used[t])} for t in range(m)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("held", pa.int32()), ("candidate", pa.int32()), ("task", pa.int32()), ("weights", pa.list_(pa.float64())), ("intercept", pa.float64()), ("used", pa.int64())]))

    sets = F.filter(F.array(*map(F.lit, [*folds, ALL])), lambda h: h != F.col("fold"))
    return moments.withColumn("held", F.explode(sets)).groupBy("held").applyInArrow(solve, kind)


def fold_scores(rows: DataFrame, weights: DataFrame, k: int, m: int, candidates: int, threshold: float = 0.5, logistic: bool = False) -> DataFrame:
    """Balanced accuracy and mean squared error of predictions clipped to [0, 1], or made probabilities, by fold, candidate and target.

    Every row is scored once, by all candidates of its fold. Targets are 0 or 1; in a fold with one class the accuracy is
    that class's recall.
    """
    held = weights.where(f"held <> {ALL}").toArrow()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for f, c, t, w, b in zip(*(held.column(x) for x in ("held", "candidate", "task", "weights", "intercept")), strict=True):
        at = by.setdefault(f.as_py(), (np.zeros((k, candidates * m)), np.zeros(candidates * m)))
        at[0][:, c.as_py() * m + t.as_py()], at[1][c.as_py() * m + t.as_py()] = w.values.to_numpy(), b.as_py()
    known = rows.sparkSession.sparkContext.broadcast(by)
    names = ("positives", "hits", "negatives", "misses", "squares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for fold, x, y, times in matrices(batches):
            for f in np.unique(fold).tolist():
                w, b = known.value[f]
                own = fold == f
                z = x[own] @ w + b
                p = (1 / (1 + np.exp(-np.clip(z, -700, 700))) if logistic else np.clip(z, 0.0, 1.0)).reshape(-1, candidates, m)
                yes, said, each = y[own][:, None, :] == 1, p >= threshold, times[own]
                total = lambda v: np.tensordot(each, v, axes=1)  # noqa: B023, E731
                new = np.stack([np.broadcast_to(total(yes), said.shape[1:]), total(yes & said), np.broadcast_to(total(~yes), said.shape[1:]), total(~yes & ~said), total((p - y[own][:, None, :]) ** 2)])
                sums[f] = sums.get(f, 0.0) + new
        for f, s in sums.items():
            c, t = np.divmod(np.arange(candidates * m), m)
            yield pa.RecordBatch.from_pydict({"fold": np.full(len(c), f, dtype=np.int32), "candidate": c.astype(np.int32), "task": t.astype(np.int32), **{x: s[j].ravel() for j, x in enumerate(names)}})

    kind = "fold int, candidate int, task int, " + ", ".join(f"{x} double" for x in names)
    total = spread(whole_rows(rows, k, m)).mapInArrow(run, kind).groupBy("fold", "candidate", "task").agg(*(F.sum(x).alias(x) for x in names))
    recall = lambda hit, of: F.when(F.col(of) > 0, F.col(hit) / F.col(of))
    up, down = recall("hits", "positives"), recall("misses", "negatives")
    ba = F.when(up.isNull(), down).when(down.isNull(), up).otherwise((up + down) / 2)
    return total.select("fold", "candidate", "task", ba.alias("balanced_accuracy"), (F.col("squares") / (F.col("positives") + F.col("negatives"))).alias("clipped_mse"))


def ranked(scores: DataFrame) -> DataFrame:
    """Candidates by mean balanced accuracy over targets and folds, then mean clipped error, then order: rank from 1."""
    from pyspark.sql import Window

    mean = scores.groupBy("candidate").agg(F.avg("balanced_accuracy").alias("balanced_accuracy"), F.avg("clipped_mse").alias("clipped_mse"))
    w = Window.orderBy(F.desc(F.round("balanced_accuracy", 9)), F.round("clipped_mse", 9), "candidate")  # a row for each candidate
    return mean.withColumn("rank", F.row_number().over(w))


def search(rows: DataFrame, k: int, m: int, grid: list[Candidate], most_folds: int = 100, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (fold, candidate, task), ranks (candidate) and weights (held, candidate, task) of a grid of models.

    The weights of the best candidate on all rows are those of rank 1 with held = -1.
    """
    folds = [r[0] for r in whole_rows(rows, k, m).select("fold").distinct().limit(most_folds + 1).collect()]
    if len(folds) > most_folds:
        raise ValueError(f"more than {most_folds} folds")
    if (len(folds) + 1) * len(grid) * m * k * 8 > MOST_BYTES:
        raise ValueError(f"the grid has more than {MOST_BYTES} bytes of weights; search it in parts")
    weights = kept(fits(fold_moments(rows, k, m, len(folds), block), k, m, sorted(folds), grid, block))
    scores = kept(fold_scores(rows, weights, k, m, len(grid)))
    return scores, kept(ranked(scores)), weights
