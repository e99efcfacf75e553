"""Random forests with all targets in one tree, grown level by level from binned histograms.

Rows have key (long), x (array of features) and y (array of targets); rows with a null, a NaN or an infinity are left
out. A level of all trees is one pass, or a few where its histograms are large; rows stay where they are, and only
sums by (tree, node, feature, bin) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.operators.folds import spread
from epochlake.operators.resample import POISSON_STEPS
from epochlake.operators.store import kept

#: Rows taken together, weighted points of a feature's summary, and most bytes of histograms in a task.
ROWS, POINTS, MOST_BYTES = 1024, 1024, 128 << 20


@dataclass
class Forest:
    """Trees as lists of nodes: feature (-1: leaf), threshold (left if at most), left and right node, value (a number for
    each target), weight (of training rows) and gain (of squared error)."""

    trees: list[list[dict]] = field(default_factory=list)

    def importances(self, k: int) -> np.ndarray:
        """Mean over trees of each feature's share of the gain."""
        out = np.zeros(k)
        for tree in self.trees:
            own = np.zeros(k)
            for node in tree:
                if node["feature"] >= 0:
                    own[node["feature"]] += node["gain"]
            out += own / (own.sum() or 1.0)
        return out / max(len(self.trees), 1)


def whole(rows: DataFrame, k: int, m: int) -> DataFrame:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    out = rows.select(F.col("key").cast("long").alias("key"), *(F.col(c).cast("array<double>").alias(c) for c in ("x", "y")))
    return out.where((F.size("x") == k) & (F.size("y") == m) & ~F.exists("x", bad) & ~F.exists("y", bad) & F.col("key").isNotNull())


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            yield part.column("key").to_numpy(), *(v.reshape(part.num_rows, len(v) // part.num_rows) for v in (part.column(c).flatten().to_numpy() for c in ("x", "y")))


def summary(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights; above so many points, groups of about equal weight stand at their last value."""
    v, inverse = np.unique(values, return_inverse=True)
    w = np.bincount(inverse, weights=weights)
    if len(v) <= POINTS:
        return v, w
    group = np.minimum((np.cumsum(w) - w / 2) / w.sum() * POINTS, POINTS - 1).astype(np.int64)
    last = np.flatnonzero(np.diff(group, append=-1))
    return v[last], np.add.reduceat(w, np.concatenate(([0], last[:-1] + 1)))


def thresholds(rows: DataFrame, k: int, bins: int) -> list[np.ndarray]:
    """Ascending split values of each feature: all but the largest of few distinct values, else quantiles."""
    kind = "feature int, v array<double>, w array<double>"
    to_arrow = pa.schema([("feature", pa.int32()), ("v", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None] * k
        for _, x, _ in parts(batches):
            for j in range(k):
                v, w = x[:, j], np.ones(len(x))
                held[j] = summary(v, w) if held[j] is None else summary(np.concatenate((held[j][0], v)), np.concatenate((held[j][1], w)))
        yield pa.RecordBatch.from_pylist([{"feature": j, "v": h[0], "w": h[1]} for j, h in enumerate(held) if h is not None], schema=to_arrow)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = np.zeros(0), np.zeros(0)
        for batch in batches:
            for r in range(batch.num_rows):
                v, w = summary(np.concatenate((v, batch.column("v")[r].values.to_numpy())), np.concatenate((w, batch.column("w")[r].values.to_numpy())))
        if len(v) > bins:
            at = np.searchsorted(np.cumsum(w), np.arange(1, bins) / bins * w.sum())
            v = v[np.unique(np.minimum(at, len(v) - 1))]
        else:
            v = v[:-1]
        yield pa.RecordBatch.from_pylist([{"feature": key[0].as_py(), "v": v, "w": []}], schema=to_arrow)

    out = [np.zeros(0)] * k
    for r in spread(rows).mapInArrow(part, kind).groupBy("feature").applyInArrow(merge, kind).collect():
        out[r["feature"]] = np.array(r["v"])
    return out


def multiplicities(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, a Poisson variable of mean one from a hash of key, tree and seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0xD1B54A32D192ED03 % 2**64) + np.uint64(seed)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return np.searchsorted(np.array(POISSON_STEPS), (z >> np.uint64(11)).astype(np.float64) / 2**53, side="right").astype(np.float64)


def places(tree: list[dict], x: np.ndarray) -> np.ndarray:
    """The node of a tree in which each row ends."""
    at = np.zeros(len(x), dtype=np.int64)
    feature, threshold, left, right = (np.array([n[c] for n in tree]) for c in ("feature", "threshold", "left", "right"))
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


def fit(rows: DataFrame, k: int, m: int, trees: int = 10, depth: int = 5, least: int = 1, share: float = 1.0, bins: int = 32, seed: int = 42, bootstrap: bool = True) -> Forest:
    """A forest of trees whose splits lessen the squared error of all m targets together.

    Every node tries ceil(share * k) features. A leaf has rows of weight `least` or more, where a row's weight in a tree
    is how often it was drawn. Of equal gains the first feature and the lowest value win. What goes to the driver and is
    broadcast is the trees, at most trees * 2 ** (depth + 1) nodes of m numbers.
    """
    if trees * 2 ** (depth + 1) * (m + 6) * 8 > 1 << 30:
        raise ValueError("trees of this number and depth are too large; grow them in parts")
    rows = kept(whole(rows, k, m))
    cuts = thresholds(rows, k, bins)
    out = Forest([[{"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "value": np.zeros(m), "weight": 0.0, "gain": 0.0}] for _ in range(trees)])
    active = [(t, 0) for t in range(trees)]
    width = max((len(c) for c in cuts), default=0) + 1
    size = width * (m + 1) * 8 * max(1, int(np.ceil(share * k)))
    for level in range(depth + 1):
        at_once = max(1, MOST_BYTES // size)
        found = [r for s in range(0, len(active), at_once) for r in best_splits(rows, out, active[s : s + at_once], cuts, k, m, width, least, share, seed, bootstrap).collect()]
        active = []
        for r in found:
            tree = out.trees[r["tree"]]
            node = tree[r["node"]]
            node["weight"], node["value"] = r["weight"], np.array(r["total"]) / max(r["weight"], 1e-300)
            if level == depth or r["gain"] is None or not r["gain"] > 1e-12 * max(1.0, r["weight"]):
                continue
            node.update(feature=r["feature"], threshold=float(cuts[r["feature"]][r["bin"]]), gain=r["gain"], left=len(tree), right=len(tree) + 1)
            active += [(r["tree"], len(tree)), (r["tree"], len(tree) + 1)]
            tree += [{"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "value": np.zeros(m), "weight": 0.0, "gain": 0.0} for _ in range(2)]
        if not active:
            break
    return out


def tried(k: int, share: float, seed: int, tree: int, node: int) -> np.ndarray:
    n = int(np.ceil(share * k))
    return np.arange(k) if n >= k else np.sort(np.random.default_rng((seed, tree, node)).choice(k, n, replace=False))


def best_splits(rows: DataFrame, forest: Forest, active: list[tuple[int, int]], cuts: list[np.ndarray], k: int, m: int, width: int, least: int, share: float, seed: int, bootstrap: bool) -> DataFrame:
    """The best split of each active node: tree, node, feature, bin, gain (null if none), weight and total of targets."""
    spark = rows.sparkSession
    by_tree: dict[int, list[int]] = {}
    for t, n in active:
        by_tree.setdefault(t, []).append(n)
    plan = [(t, forest.trees[t], nodes, [tried(k, share, seed, t, n) for n in nodes]) for t, nodes in by_tree.items()]
    known = spark.sparkContext.broadcast((plan, cuts))
    to_arrow = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("h", pa.list_(pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, cuts = known.value
        held: dict[tuple[int, int], np.ndarray] = {}
        for keys, x, y in parts(batches):
            binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
            for t, tree, nodes, features in plan:
                weight = multiplicities(keys, t, seed) if bootstrap else np.ones(len(keys))
                at = places(tree, x)
                for n, own in zip(nodes, features, strict=True):
                    here = np.flatnonzero((at == n) & (weight > 0))
                    if not len(here):
                        continue
                    cell = (binned[np.ix_(here, own)] + np.arange(len(own)) * width).ravel()
                    h = held.setdefault((t, n), np.zeros((m + 1, len(own) * width)))
                    for c in range(m + 1):
                        v = weight[here] if c == 0 else weight[here] * y[here, c - 1]
                        h[c] += np.bincount(cell, weights=np.repeat(v, len(own)), minlength=len(own) * width)
        for (t, n), h in held.items():
            own = tried(k, share, seed, t, n)
            for j, f in enumerate(own.tolist()):
                yield pa.RecordBatch.from_pylist([{"tree": t, "node": n, "feature": f, "h": h[:, j * width : (j + 1) * width].ravel()}], schema=to_arrow)

    def split(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = 0.0
        for batch in batches:
            for r in range(batch.num_rows):
                h = h + batch.column("h")[r].values.to_numpy()
        left = np.cumsum(h.reshape(m + 1, width), axis=1)
        total, left = left[:, -1], left[:, :-1]
        right = total[:, None] - left
        ok = (left[0] >= least) & (right[0] >= least)
        gain, at = None, 0
        if ok.any():
            error = lambda s: (s[1:] ** 2).sum(axis=0) / np.where(s[0] > 0, s[0], 1.0)
            gains = np.where(ok, error(left) + error(right) - error(total), -np.inf)
            at = int(np.argmax(gains))
            gain = float(gains[at])
        yield pa.RecordBatch.from_pylist([{**{c: v.as_py() for c, v in zip(("tree", "node", "feature"), key, strict=True)}, "bin": at, "gain": gain, "weight": total[0], "total": total[1:]}], schema=found_arrow)

    found_arrow = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("weight", pa.float64()), ("total", pa.list_(pa.float64()))])
    each = spread(rows).mapInArrow(part, "tree int, node int, feature int, h array<double>").groupBy("tree", "node", "feature")
    found = each.applyInArrow(split, "tree int, node int, feature int, bin int, gain double, weight double, total array<double>")
    # gains that differ by rounding are equal
    top = F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("feature")).alias("place"), "feature", "bin", "weight", "total"))
    return found.groupBy("tree", "node").agg(top.alias("b")).select("tree", "node", "b.gain", "b.feature", "b.bin", "b.weight", "b.total").orderBy("tree", "node")


def predict(rows: DataFrame, forest: Forest, k: int) -> DataFrame:
    """Key and predictions p (array) of each row, mean over the trees; rows that don't have k finite features are left out."""
    known = rows.sparkSession.sparkContext.broadcast(forest.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [np.stack([n["value"] for n in tree]) for tree in known.value]
        for keys, x, _ in parts(batches):
            p = sum(v[places(tree, x)] for tree, v in zip(known.value, values, strict=True)) / len(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(p), pa.list_(pa.float64()))], names=["key", "p"])

    return whole(rows.select("key", "x", F.array().cast("array<double>").alias("y")), k, 0).mapInArrow(run, "key long, p array<double>")
