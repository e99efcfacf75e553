"""Many logistic models at once: every round is one pass that holds loss, gradient and Hessian of all candidates.

Models of all candidates, folds and targets move together by Newton steps; those with a penalty of absolute values take
the step's quadratic form with that penalty. The number of passes doesn't depend on the number of models. Passes go over
the distinct rows with their numbers, which are gathered once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.operators.folds import ALL, MOST_BYTES, Candidate, Fits, assembled, counted, fold_moments, fold_scores, matrices, ranked, spread, whole_rows
from epochlake.operators.folds import BLOCK as FOLD_BLOCK
from epochlake.operators.store import kept


@dataclass(frozen=True)
class Logit:
    """A model of a grid: the k features with the best F score of a family (None: all), scaled to unit variance or not.

    c is the inverse penalty on the sum of losses, l1 the share of absolute values in it; balanced weights both classes
    alike. The intercept isn't penalised.
    """

    k: int
    c: float = 1.0
    l1: float = 0.0
    balanced: bool = False
    features: tuple[int, ...] | None = None
    scaled: bool = True


@dataclass
class State:
    """One model on its way: w holds weights on the scaled features at and, last, the intercept."""

    held: int
    candidate: int
    task: int
    at: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    class_weight: tuple[float, float]
    ridge: float
    lasso: float
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    had: np.ndarray | None = None  # the last accepted weights, their objective, and the step taken from them
    objective: float = np.inf
    step: np.ndarray | None = None
    size: float = 1.0
    done: bool = False


def direction(h: np.ndarray, g: np.ndarray, w: np.ndarray, ridge: float, lasso: float) -> np.ndarray:
    """The step that minimises the quadratic form of the loss with the penalties; the last weight has none."""
    n = len(w)
    free = np.ones(n)
    free[-1] = 0.0
    h, g = h + np.diag(ridge * free + 1e-10 * max(np.trace(h) / n, 1e-300)), g + ridge * free * w
    if not lasso:
        return -np.linalg.solve(h, g)
    d, slope = np.zeros(n), g.copy()
    for _ in range(2000):
        most = 0.0
        for j in range(n):
            a, b = h[j, j], slope[j] - h[j, j] * d[j]
            z = a * w[j] - b
            new = (np.sign(z) * max(abs(z) - lasso * free[j], 0.0)) / a - w[j]
            if new != d[j]:
                slope += h[:, j] * (new - d[j])
                most = max(most, abs(new - d[j]) * np.sqrt(a))
                d[j] = new
        if most <= 1e-10 * max(1.0, np.abs(d).max()):
            break
    return d


def advance(s: State, loss: float, g: np.ndarray, h: np.ndarray, tolerance: float) -> None:
    """Accept the weights that were evaluated and step on, or halve the step that led to them."""
    objective = loss + s.ridge * (s.w[:-1] ** 2).sum() / 2 + s.lasso * np.abs(s.w[:-1]).sum()
    if s.had is not None and objective > s.objective + 1e-12 * abs(s.objective) and s.size > 1e-9:
        s.size /= 2
        s.w = s.had + s.size * s.step
        return
    d = direction(h, g, s.w, s.ridge, s.lasso)
    s.done = bool(np.abs(d).max() <= tolerance * max(1.0, np.abs(s.w).max()))
    s.had, s.objective, s.step, s.size = s.w, objective, d, 1.0
    s.w = s.w + d


def choices(moments: DataFrame, k: int, m: int, folds: list[int], grid: list[Logit], block: int = FOLD_BLOCK) -> DataFrame:
    """Features of each model with their means and deviations, and both classes' row counts, from its training set."""
    kind = "held int, candidate int, task int, at array<int>, mean array<double>, scale array<double>, negatives double, positives double"

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        own, rows = Fits(assembled(table, k + m, block), k), []
        for g, c in enumerate(grid):
            for t in range(m):
                at, yes = own.chosen(Candidate("logit", c.k, c.features), t), own.n * own.mean[k + t]
                rows.append({"held": key[0].as_py(), "candidate": g, "task": t, "at": at, "mean": own.mean[at], "scale": np.sqrt(own.var[at]), "negatives": own.n - yes, "positives": yes})
        doubles = pa.list_(pa.float64())
        return pa.Table.from_pylist(rows, schema=pa.schema([("held", pa.int32()), ("candidate", pa.int32()), ("task", pa.int32()), ("at", pa.list_(pa.int32())), ("mean", doubles), ("scale", doubles), ("negatives", pa.float64()), ("positives", pa.float64())]))

    sets = F.filter(F.array(*map(F.lit, [*folds, ALL])), lambda h: h != F.col("fold"))
    return moments.withColumn("held", F.explode(sets)).groupBy("held").applyInArrow(choose, kind)


def sums(rows: DataFrame, states: dict[int, State]) -> dict[int, np.ndarray]:
    """Loss, gradient and Hessian (end to end) of each state's weights over its training rows, from one pass."""
    groups: dict[tuple, list[int]] = {}
    for i, s in states.items():
        groups.setdefault((s.held, tuple(s.at.tolist()), tuple(s.mean.tolist()), tuple(s.scale.tolist())), []).append(i)
    plan = [(key[0], np.array(key[1], dtype=np.int64), np.array(key[2]), np.array(key[3]), own, np.stack([states[i].w for i in own], axis=1), np.array([states[i].task for i in own]), np.array([states[i].class_weight for i in own])) for key, own in groups.items()]
    known = rows.sparkSession.sparkContext.broadcast(plan)
    kind = "model int, v array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for fold, x, y, times in matrices(batches):
            for held, at, mean, scale, own, w, task, weight in known.value:
                rest = fold != held
                if not rest.any():
                    continue
                z = np.concatenate(((x[rest][:, at] - mean) / scale, np.ones((int(rest.sum()), 1))), axis=1)
                yes = y[rest][:, task] == 1
                margin, by = z @ w, np.where(yes, weight[:, 1], weight[:, 0]) * times[rest][:, None]
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss = (by * np.logaddexp(0, np.where(yes, -margin, margin))).sum(axis=0)
                g, v = z.T @ (by * (p - yes)), by * p * (1 - p)
                for q, i in enumerate(own):
                    new = np.concatenate(([loss[q]], g[:, q], (z.T @ (z * v[:, q : q + 1])).ravel()))
                    total[i] = total.get(i, 0.0) + new
        for i, v in total.items():
            yield pa.RecordBatch.from_pylist([{"model": i, "v": v}], schema=to_arrow)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = 0.0
        for batch in batches:
            for r in range(batch.num_rows):
                v = v + batch.column("v")[r].values.to_numpy()
        yield pa.RecordBatch.from_pylist([{"model": key[0].as_py(), "v": v}], schema=to_arrow)

    to_arrow = pa.schema([("model", pa.int32()), ("v", pa.list_(pa.float64()))])
    table = spread(rows).mapInArrow(part, kind).groupBy("model").applyInArrow(merge, kind).toArrow()
    return {i.as_py(): v.values.to_numpy() for i, v in zip(table.column("model"), table.column("v"), strict=True)}


def fit_all(rows: DataFrame, chosen: DataFrame, grid: list[Logit], rounds: int = 100, tolerance: float = 1e-9) -> tuple[list[State], int]:
    """All models fitted on rows that are kept, and the number of passes; an error if some don't come to rest."""
    states: dict[int, State] = {}
    for i, r in enumerate(chosen.orderBy("held", "candidate", "task").collect()):
        c, n = grid[r["candidate"]], r["negatives"] + r["positives"]
        weight = tuple(n / (2 * x) if c.balanced and x > 0 else 1.0 for x in (r["negatives"], r["positives"]))
        scale = np.array(r["scale"]) if c.scaled else np.ones(len(r["at"]))
        states[i] = State(r["held"], r["candidate"], r["task"], np.array(r["at"], dtype=np.int64), np.array(r["mean"]), scale, weight, (1 - c.l1) / c.c, c.l1 / c.c, np.zeros(len(r["at"]) + 1))
    if sum(8 * (len(s.w) + 1) ** 2 for s in states.values()) > MOST_BYTES:
        raise ValueError(f"the models' sums have more than {MOST_BYTES} bytes; fit them in parts")
    passes = 0
    while any(not s.done for s in states.values()):
        if passes == rounds:
            raise RuntimeError(f"after {rounds} rounds some models haven't come to rest")
        open_ = {i: s for i, s in states.items() if not s.done}
        found, passes = sums(rows, open_), passes + 1
        for i, s in open_.items():
            n, v = len(s.w), found.get(i, np.zeros(1 + len(s.w) + len(s.w) ** 2))
            advance(s, v[0], v[1 : n + 1], v[n + 1 :].reshape(n, n), tolerance)
    return list(states.values()), passes


def search(rows: DataFrame, k: int, m: int, grid: list[Logit], most_folds: int = 100, refit: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (fold, candidate, task), ranks (candidate) and weights (held, candidate, task, weights, intercept, used).

    Features are chosen by the training rows of each fold. The weights on all rows are those with held = -1. Targets are
    0 or 1; the class of a row is 1 from a probability of one half on.
    """
    rows = kept(counted(whole_rows(rows, k, m)))
    folds = sorted(r[0] for r in rows.select("fold").distinct().limit(most_folds + 1).collect())
    if len(folds) > most_folds:
        raise ValueError(f"more than {most_folds} folds")
    chosen = choices(fold_moments(rows, k, m, len(folds)), k, m, folds, grid)
    states, _ = fit_all(rows, chosen if refit else chosen.where(f"held <> {ALL}"), grid)
    weights = kept(weights_of(rows, states, k))
    scores = kept(fold_scores(rows, weights, k, m, len(grid), logistic=True))
    return scores, kept(ranked(scores)), weights


def weights_of(rows: DataFrame, states: list[State], k: int) -> DataFrame:
    """Weights of all features on their own scale, 0 for those not chosen."""
    out = []
    for s in states:
        w = np.zeros(k)
        w[s.at] = s.w[:-1] / s.scale
        out.append((s.held, s.candidate, s.task, w.tolist(), float(s.w[-1] - s.mean @ w[s.at]), len(s.at)))
    return rows.sparkSession.createDataFrame(out, "held int, candidate int, task int, weights array<double>, intercept double, used long")


def one_vs_rest(df: DataFrame, k: int, classes: int, model: Logit) -> DataFrame:
    """Weights of each class (y from 0) against all others, x an array of k features: held = -1, task is the class."""
    is_class = F.array(*((F.col("y") == c).cast("double") for c in range(classes)))
    rows = kept(counted(whole_rows(df.select(F.lit(0).alias("fold"), "x", is_class.alias("y")), k, classes)))
    chosen = choices(fold_moments(rows, k, classes, 1), k, classes, [], [model])
    return weights_of(rows, fit_all(rows, chosen, [model])[0], k)
