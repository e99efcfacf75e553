"""Benchmark leaks: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted-shingle similarity."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifiers import RUN_CLASS
from .common import slices, texts_of
from .text import LOWER, WORD_BASE, Rolling, as_bytes, mix, word_hashes

SHINGLE = 5
#: Two windows of similarity 0.8 have fingerprints that differ in 39 bits on average and in more than RADIUS once in a
#: million cases; other texts' differ in 128. Of so many blocks one differs in two bits at most.
BITS = 256
RADIUS = 68
BLOCKS = 23
STRETCH = 1024
#: Characters of benchmark text that one broadcast index holds; larger benchmarks are taken in several parts.
PART_CHARS = 20_000_000
#: Items of one index, each of about 15 kB in every Python worker.
PART_ITEMS = 8_000
SEEN_BITS = 20


def token_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the runs of letters, digits and non-ASCII bytes; ASCII lower-cased, punctuation ignored."""
    low = LOWER[raw]
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = RUN_CLASS[low] == 1
    edges = np.flatnonzero(np.diff(inside))
    return word_hashes(low, edges[::2], edges[1::2])


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """Plus or minus one for each bit of BITS hash bits of each shingle."""
    words = np.stack([mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash of each row of sums, BITS / 64 words a row."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller counts over sum of larger counts of all shingles."""
    values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class HammingIndex:
    """Fingerprints within a radius: cut into blocks, one block differs in at most radius // blocks bits.

    Each fingerprint is listed under every block value within that distance, so one lookup per block finds all
    fingerprints within the radius; others are removed by their full distance. The lists of all blocks lie end to end
    in one array, and all blocks of all queries are looked up together.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        cuts = [BITS * k // blocks for k in range(blocks + 1)]
        widest = max(hi - lo for lo, hi in itertools.pairwise(cuts))
        self.weights = np.zeros((BITS, blocks), dtype=np.float32)  # of bits in a block's value; these stay below 2^24
        for k, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            self.weights[lo:hi, k] = 2.0 ** np.arange(hi - lo)
        self.first = np.arange(blocks, dtype=np.int32) << widest
        keys = self.keys(prints)
        listed, owner = [], []
        for k, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            near = [sum(1 << b for b in some) for n in range(radius // blocks + 1) for some in itertools.combinations(range(hi - lo), n)]
            listed.append((keys[:, k, None] ^ np.array(near, dtype=np.int32)[None, :]).ravel())
            owner.append(np.repeat(np.arange(len(prints), dtype=np.int32), len(near)))
        listed, owner = np.concatenate(listed), np.concatenate(owner)
        order = np.argsort(listed, kind="stable")
        self.listed, self.owner = listed[order].astype(np.int32), owner[order]

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """Block values of each fingerprint, told apart by block: a row each, a column for each block."""
        bits = np.unpackbits(prints.view(np.uint8), axis=1).astype(np.float32)
        return (bits @ self.weights).astype(np.int32) + self.first

    def within(self, prints: np.ndarray) -> np.ndarray:
        """Pairs (query, fingerprint) within the radius."""
        keys = self.keys(prints)
        a = np.searchsorted(self.listed, keys.ravel())
        n = np.searchsorted(self.listed, keys.ravel(), side="right") - a
        total = n.reshape(keys.shape).sum(axis=1)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - a, n)
        near = np.zeros((len(prints), len(self.prints)), dtype=bool)
        near[np.repeat(np.arange(len(prints)), total), self.owner[at]] = True
        rows, owner = np.nonzero(near)
        far = np.bitwise_count(prints[rows] ^ self.prints[owner]).sum(axis=1, dtype=np.int64)
        close = far <= self.radius
        return np.stack((rows[close], owner[close]), axis=1)


def stretches(start: np.ndarray, width: int) -> list[np.ndarray]:
    """Ascending windows in parts that lie together, so that sums are kept for what the windows of a part cover."""
    if not len(start):
        return []
    gaps = np.flatnonzero(np.diff(start) > width) + 1
    return [p[k : k + STRETCH] for p in np.split(start, gaps) for k in range(0, len(p), STRETCH)]


class Benchmark:
    """Items by their number of words, ready for lookup."""

    def __init__(self, items: list[tuple[int, bytes]], p: int, q: int):
        self.p, self.q = p, q
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            words = token_hashes(as_bytes(text))
            if len(words):
                k = min(SHINGLE, len(words))
                by_size.setdefault((k, len(words)), []).append((item, Rolling(words, WORD_BASE).windows(k)))
        self.sizes = []
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {k for k, _ in by_size}:
            known = np.unique(np.concatenate([s for (kk, _), group in by_size.items() if kk == k for _, s in group]))
            table = np.zeros(1 << SEEN_BITS, dtype=bool)
            table[(known >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
            self.seen[k] = known, table
        for (k, size), group in sorted(by_size.items()):
            prints = np.concatenate([fingerprints(bit_signs(s).sum(axis=0, keepdims=True)) for _, s in group])
            self.sizes.append((k, size - k + 1, [g[0] for g in group], np.stack([g[1] for g in group]), HammingIndex(prints)))

    def leaks(self, raw: np.ndarray) -> dict[int, float]:
        """Items that a window of the text is similar to, with the best similarity."""
        words = token_hashes(raw)
        found: dict[int, float] = {}
        hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (known, table) in self.seen.items():
            grams = Rolling(words, WORD_BASE).windows(k)
            at = np.flatnonzero(table[(grams >> np.uint64(64 - SEEN_BITS)).astype(np.int64)]) if len(grams) else np.zeros(0, dtype=np.int64)
            at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
            if len(at):
                hit = np.zeros(len(grams) + 1, dtype=np.int64)
                hit[at + 1] = 1
                hits[k] = grams, np.cumsum(hit)
        for k, width, items, sets, index in self.sizes:
            if k not in hits:
                continue
            grams, total = hits[k]
            if len(grams) < width:
                # the text is its one window; similar ones share at least p / (p + q) of all shingles of both
                least = self.p * (width + len(grams))
                if total[-1] * (self.p + self.q) >= least:
                    for item in np.flatnonzero(np.isin(sets, grams).sum(axis=1) * (self.p + self.q) >= least).tolist():
                        s = weighted_similarity(grams, sets[item])
                        if s * self.q >= self.p and s > found.get(items[item], 0.0):
                            found[items[item]] = s
                continue
            # similar windows share at least 2p / (p + q) of their shingles with the item, so with all items
            start = np.flatnonzero((total[width:] - total[:-width]) * (self.p + self.q) >= 2 * self.p * width)
            for part in stretches(start, width):
                low = int(part[0])
                signs = np.zeros((int(part[-1]) + width - low + 1, BITS), dtype=np.int32)
                np.cumsum(bit_signs(np.ascontiguousarray(grams[low : part[-1] + width])), axis=0, out=signs[1:])
                prints = fingerprints(signs[part - low + width] - signs[part - low])
                for row, item in index.within(prints).tolist():
                    s = weighted_similarity(grams[part[row] : part[row] + width], sets[item])
                    if s * self.q >= self.p and s > found.get(items[item], 0.0):
                        found[items[item]] = s
        return found


_built: dict[str, Benchmark] = {}


def benchmark_of(name: str, held: Broadcast, p: int, q: int) -> Benchmark:
    """One index for all tasks that a Python worker runs on this part of the items."""
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(held.value, p, q)
    return _built[name]


def leaks(docs: DataFrame, items: DataFrame, p: int = 80, q: int = 100) -> DataFrame:
    """Documents that hold a benchmark item: a row (doc_id, item_id, similarity) for each document and item.

    An item of n words is compared with every window of n words of the whole text. Windows that share too few
    five-word shingles with all items to reach p/q are ruled out by that bound. The SimHash of the others is looked
    up among the items' within RADIUS bits, and what is found is verified: counts of shingles, sum of smaller over
    sum of larger, at least p/q. Words are lower-cased runs of letters and digits. Items of fewer than five words
    count as one shingle; a text of fewer words than an item is compared with it as a whole, without SimHash; items without words, and null items, match nothing. Null and empty texts hold nothing.
    Rows that repeat give repeated rows; null ids stay null; other columns are never read; long texts count whole.
    SimHash of 256 bits at radius 68 misses a window just at the threshold in about one case of a million.

    The items of a part (about PART_CHARS characters and PART_ITEMS items at most) are broadcast; a larger benchmark takes
    several passes.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    chars, number = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-int(chars) // PART_CHARS), -(-number // PART_ITEMS))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
        held = docs.sparkSession.sparkContext.broadcast(list(zip(rows.column("item_id").to_pylist(), [t.encode() for t in rows.column("text").to_pylist()], strict=True)))

        def run(batches: Iterator[pa.RecordBatch], held=held, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            bench = benchmark_of(name, held, p, q)
            for batch in slices(batches):
                at, item, best = [], [], []
                for row, t in enumerate(texts_of(batch, "text")):
                    for i, s in bench.leaks(as_bytes(t)).items():
                        at.append(row)
                        item.append(i)
                        best.append(s)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(best, pa.float64())], names=["doc_id", "item_id", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, item_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out
