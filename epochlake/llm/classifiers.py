"""Linear text classifiers: naive-Bayes-scaled character n-grams, and hashed word n-grams trained by FTRL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts_of, written
from .text import BYTE_BASE, WORD_BASE, Rolling, as_bytes, word_hashes

#: Bounds of what a classifier is fitted on: rows, and bytes of their texts; a single text has an eighth at most.
MAX_ROWS = 8000
MAX_BYTES = 48_000_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[Column], Column], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Texts and labels (text, y) of at most max_rows labelled documents outside the held-out fold.

    The rows are those whose id has the smallest hash, so the choice doesn't depend on order, as far as their texts
    have max_bytes together; texts larger than an eighth of that aren't learnt from. Ids without a label of 0 or 1
    are left out; an id with several labels counts with the largest; rows that repeat id and text are one. The id
    list is bounded, so it is broadcast and the documents aren't shuffled; the rows are stored, read once.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), size.alias("bytes")).where(F.col("bytes") <= max_bytes // 8)
    rows = written(rows.join(F.broadcast(ids), "doc_id"), f"labelled-{label}")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("tie")]
    keys = rows.select("doc_id", "tie", "bytes").distinct().orderBy(*order).limit(max_rows)
    total = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # max_rows rows at most
    keys = keys.withColumn("total", total).where(F.col("total") <= max_bytes).select("doc_id", "tie")
    return rows.join(F.broadcast(keys), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"]).select("text", "y")


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def collected(df: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Feature numbers, values and labels of a bounded sample, in an order that doesn't depend on the run."""
    got = df.toArrow()
    rows = sorted(zip(got.column("y").to_pylist(), got.column("idx").to_pylist(), got.column("val").to_pylist(), strict=True))
    idx = [np.frombuffer(r[1], dtype=np.int32) for r in rows]
    return idx, [np.frombuffer(r[2], dtype=np.float32) for r in rows], np.array([r[0] for r in rows], dtype=np.float64)


def features_of(sample: DataFrame, extract: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = [extract(as_bytes(t)) for t in texts_of(batch, "text")]
            cols = [pa.array([x.astype(kind).tobytes() for x in part], pa.binary()) for part, kind in (([p[0] for p in pairs], np.int32), ([p[1] for p in pairs], np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *cols], names=["y", "idx", "val"])

    return sample.mapInArrow(run, "y int, idx binary, val binary")


def scored(docs: DataFrame, score: Callable[[np.ndarray], float], held_out: Column, threshold: float, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, with docs' other columns if keep; nothing is shuffled."""
    new = ("held_out", "score", "predicted")
    names = [c for c in docs.columns if c.lower() not in new] if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = pa.array([score(as_bytes(t)) for t in texts_of(batch, "text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("held_out"), out], names=[*names, "held_out", "score"])

    base = docs.select(*names, *(["text"] if "text" not in names else []), held_out.alias("held_out"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return base.mapInArrow(run, f"{kinds}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


# --- character n-grams scaled by naive Bayes log-count ratios ---

GRAM_SIZES = (3, 4, 5)
GRAM_BITS = 22
#: Log-likelihood ratio above which every n-gram is a feature; chance alone passes this for one in 100,000.
APART = 20.0
#: The n-grams that stand out most are features in any case, so many of those that chance passes for one in a hundred.
LEAST_GRAMS = 500
SLIGHTLY_APART = 6.6


def gram_buckets(raw: np.ndarray) -> np.ndarray:
    """Hash buckets of all character n-grams of a text; lower-cased, every run of white space one space."""
    text = " " + " ".join(raw.tobytes().decode("utf-8", "replace").lower().split()) + " "
    rolling = Rolling(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1), BYTE_BASE)
    return np.concatenate([(rolling.windows(n) ^ np.uint64(n)) >> np.uint64(64 - GRAM_BITS) for n in GRAM_SIZES]).astype(np.int32)


def gram_counts(sample: DataFrame) -> DataFrame:
    """Documents of each label that hold each n-gram bucket: (gram, y1, y0); partial sums leave each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << GRAM_BITS), dtype=np.int32)
        for batch in slices(batches):
            for t, y in zip(texts_of(batch, "text"), batch.column("y").to_pylist(), strict=True):
                total[y][np.unique(gram_buckets(as_bytes(t)))] += 1
        some = np.flatnonzero(total.any(axis=0))
        for k in range(0, len(some), 50_000):
            part = some[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[1][part]), pa.array(total[0][part])], names=["gram", "y1", "y0"])

    return sample.mapInArrow(run, "gram int, y1 int, y0 int").groupBy("gram").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def apart_from_chance(y1: Column, y0: Column, pos: int, neg: int) -> Column:
    """Log-likelihood ratio statistic of a feature held by y1 of pos and y0 of neg rows."""

    def part(seen: Column, rows: int, all_seen: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * (pos + neg) / (all_seen * rows))).otherwise(0.0)

    return 2 * (part(y1, pos, y1 + y0) + part(y0, neg, y1 + y0) + part(pos - y1, pos, pos + neg - y1 - y0) + part(neg - y0, neg, pos + neg - y1 - y0))


def fit_logistic(idx: list[np.ndarray], scale: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on present features times their scale, by full-batch Adam; returns weights and bias."""
    n, size = len(y), len(scale)
    flat = np.concatenate(idx) if idx else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(n), [len(x) for x in idx])
    w, bias = np.zeros(size + 1), np.log((y.sum() + 1) / (n - y.sum() + 1))
    w[size] = bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = np.where(y == 1, 0.5 * n / max(1, y.sum()), 0.5 * n / max(1, n - y.sum()))
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(row, weights=(w[:size] * scale)[flat], minlength=n) + w[size])
        d = weight * (p - y) / max(1, n)
        g = np.append(np.bincount(flat, weights=d[row], minlength=size) * scale + l2 * w[:size], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size] * scale, float(w[size])


def chosen_grams(counts: DataFrame, pos: int, neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that are features, ascending, and their naive Bayes log-count ratios; bounded by the hash space."""
    ratio = F.log((F.col("y1") + 1) / (pos + 2)) - F.log((F.col("y0") + 1) / (neg + 2))
    apart = apart_from_chance(F.col("y1"), F.col("y0"), pos, neg)
    grams = counts.select("gram", ratio.alias("r"), apart.alias("g")).where(F.col("g") > SLIGHTLY_APART).toArrow()
    gram, r, g = (grams.column(c).to_numpy() for c in ("gram", "r", "g"))
    rank = np.lexsort((gram, -g))
    kept = np.sort(rank[: max(LEAST_GRAMS, int((g > APART).sum()))])
    kept = kept[np.argsort(gram[kept])]
    return gram[kept], r[kept]


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted (score >= 0.5).

    Binary character n-gram features are scaled by their naive Bayes log-count ratio and weighted by logistic
    regression. Features are the n-grams whose ratio stands out from chance, so long texts don't gather noise.
    Labels are learnt from rows whose crc32(doc_id) mod 5 isn't 0, at most max_rows of them (see labelled_sample).
    Null and empty texts score as texts without features; with labels of one kind only every score is their smoothed
    share of toxic rows, without labels 0. Rows that repeat are scored each; ids may be null; texts count whole;
    other columns are never read.
    """
    sample = labelled_sample(docs, labels, "toxic", lambda c: fold(c, 5) != 0, max_rows)
    held = fold(F.col("doc_id"), 5) == 0
    per = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = per.get(1, 0), per.get(0, 0)
    if not pos or not neg:
        flat = (pos + 1) / (pos + neg + 2) if pos + neg else 0.0
        return scored(docs, lambda raw: flat, held, 0.5)
    grams, ratios = chosen_grams(gram_counts(sample), pos, neg)
    number = np.full(1 << GRAM_BITS, -1, dtype=np.int32)
    number[grams] = np.arange(len(grams))
    table = docs.sparkSession.sparkContext.broadcast(number)

    def present(raw: np.ndarray) -> np.ndarray:
        got = table.value[gram_buckets(raw)]
        return np.unique(got[got >= 0])

    idx, _, y = collected(features_of(sample, lambda raw: (present(raw), np.zeros(0))))
    weights, bias = fit_logistic(idx, ratios, y)
    return scored(docs, lambda raw: float(sigmoid(weights[present(raw)].sum() + bias)), held, 0.5)


# --- hashed word n-grams, FTRL ---

WORD_BITS = 18
RUN_CLASS = np.full(256, 2, dtype=np.int8)
RUN_CLASS[[9, 10, 11, 12, 13, 32]] = 0
RUN_CLASS[48:58] = RUN_CLASS[65:91] = RUN_CLASS[97:123] = RUN_CLASS[128:] = 1


def token_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of word characters and runs of other visible characters."""
    kind = np.zeros(len(raw) + 2, dtype=np.int8)
    kind[1:-1] = RUN_CLASS[raw]
    cuts = np.flatnonzero(np.diff(kind))
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts + 1] > 0
    return starts[seen], ends[seen]


def word_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word 1- and 2-grams and their counts over the L2 norm."""
    words = word_hashes(raw, *token_bounds(raw))
    grams = np.concatenate((words, Rolling(words, WORD_BASE).windows(2))) >> np.uint64(64 - WORD_BITS)
    idx, count = np.unique(grams.astype(np.int32), return_counts=True)
    return idx, (count / np.sqrt(np.square(count, dtype=np.float64).sum()) if len(idx) else count).astype(np.float32)


def fit_ftrl(idx: list[np.ndarray], val: list[np.ndarray], y: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1) -> np.ndarray:
    """Follow-the-regularised-leader (proximal) updates; returns weights, the bias last."""
    size = 1 << WORD_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.sign(zz) * -np.maximum(np.abs(zz) - penalty[at], 0.0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(y)):
            at, x = np.append(idx[k], size), np.append(val[k], 1.0)
            w = weights(at)
            g = (sigmoid(float(w @ x)) - y[k]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: bool = False) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted (score >= 0.7); other columns too if keep.

    Hashed word 1- and 2-grams (runs of word characters, runs of other characters) of the whole text, logistic
    regression by FTRL; a score is one sparse dot product. Labels are learnt from rows whose crc32(doc_id) mod 4
    isn't 2, at most max_rows of them (see labelled_sample). Null and empty texts score by the bias; with labels of
    one kind only every score is their smoothed share of good rows, without labels 0. Rows that repeat are scored
    each; ids may be null; texts count whole; columns named like the new ones are replaced.
    """
    sample = labelled_sample(docs, labels, "quality", lambda c: fold(c, 4) != 2, max_rows)
    held = fold(F.col("doc_id"), 4) == 2
    idx, val, y = collected(features_of(sample, word_features))
    if len(np.unique(y)) < 2:
        flat = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0
        return scored(docs, lambda raw: float(flat), held, 0.7, keep)
    model = docs.sparkSession.sparkContext.broadcast(fit_ftrl(idx, val, y))

    def score(raw: np.ndarray) -> float:
        idx, val = word_features(raw)
        return float(sigmoid(float(model.value[idx] @ val) + model.value[-1]))

    return scored(docs, score, held, 0.7, keep)
