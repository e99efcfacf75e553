"""Repeated passages: word windows that repeat, after a count-min prefilter; byte windows with an earlier factor.

Both operators look at every window of a fixed length (words or bytes) of every document. Windows are dealt by
anchors (minimizers): a window's smallest gram depends on its content alone, so equal windows share an anchor,
and runs of windows with one anchor travel as one segment: an anchor, a content hash and a place, not the text.
Segments are shuffled once, by anchor, and told apart as they stream by in order: copies of a segment are marked at
once, an anchor's only segment is done with, and only segments whose anchor has different ones fetch their content,
each once. An anchor with more content than one task should hold is dealt out by longer anchors of the same windows,
in the end by the windows themselves; the comparison is the same at every level. Anchors that stand in many documents
are salted: their copies are passed in parts, and only the first segments of each part meet.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, written
from .text import BYTE_BASE, WORD_BASE, Rolling, anchored_runs, as_bytes, byte_values, mix, word_bounds, word_hashes

#: Words or bytes that the segments of one anchor may hold together before longer anchors deal them out.
GROUP_UNITS = 3_000_000
#: Segments of one anchor that a task holds before it passes them on to longer anchors unseen.
GROUP_ROWS = 50_000
#: Documents looked at for anchors that stand in a hundredth of them or more, and parts that such anchors are dealt to.
LOOKED_AT = 5000
SALTS = 64
#: Segments for longer anchors that are broadcast to the texts instead of shuffled to them (some megabytes).
FEW = 100_000
BLOCK_BITS = 16
FLUSH = 2_000_000
#: The sketch has four cells a row for each segment, and so many bits a row at most (4 * 2^25 bits are 16 MB).
MOST_BITS = 25


# --- documents with a key that tells repeated ids apart ---


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, text, other columns, kd (id, null as the smallest value) and tie (hash of the text).

    Rows with equal id and text are one document that is returned as often as it stands; rows with one id and
    different texts are different documents, ordered by tie.
    """
    return docs.select("doc_id", "text", *others, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kd"), F.xxhash64("text").alias("tie"))


# --- segments ---


@dataclass(frozen=True)
class Kind:
    """What windows are made of: units of a text as 64-bit values, units of a window, units of the grams by level."""

    values: Callable[[np.ndarray], np.ndarray]
    base: int
    width: int
    grams: tuple[int, ...]


BYTES = Kind(byte_values, BYTE_BASE, 100, (20, 60, 100))
WORDS = Kind(lambda raw: word_hashes(raw, *word_bounds(raw)), WORD_BASE, 35, (8, 20, 35))
SEGMENT = "h long, salt int, sh int, kd long, tie long, start int, n int, again boolean"


def segments_of(values: np.ndarray, kind: Kind, level: int) -> tuple[np.ndarray, ...]:
    """Anchors, content hashes, first windows, window counts of a text's segments, and whether the anchor recurs."""
    rolling, gram = Rolling(values, kind.base), kind.grams[level]
    h, first, count, again = anchored_runs(rolling.raw_windows(gram), kind.width - gram + 1)
    sh = rolling.ranges(first, first + count + (kind.width - 1)) >> np.uint64(32)
    return h.view(np.int64), sh.astype(np.uint32).view(np.int32), first, count, again


def segment_batch(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if parts:
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)


def segments(base: DataFrame, kind: Kind, common: np.ndarray | None = None) -> DataFrame:
    """All segments of all documents, anchored by the shortest grams; those of common anchors salted by document."""
    common = np.zeros(0, dtype=np.int64) if common is None else common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for t, kd, tie in zip(texts_of(batch, "text"), batch.column("kd").to_numpy(), batch.column("tie").to_numpy(), strict=True):
                h, sh, first, count, again = segments_of(kind.values(as_bytes(t)), kind, 0)
                if len(h):
                    salt = np.where(np.isin(h, common), 1 + int(tie) % SALTS, 0).astype(np.int32)
                    parts.append((h, salt, sh, np.full(len(h), kd), np.full(len(h), tie), first.astype(np.int32), count.astype(np.int32), again))
            yield from segment_batch(parts)

    return base.select("text", "kd", "tie").mapInArrow(run, SEGMENT)


def common_anchors(base: DataFrame, kind: Kind) -> np.ndarray:
    """Anchors that stand in a hundredth of some documents, for salting only; no result depends on which they are."""
    every = max(1, base.count() // LOOKED_AT)
    some = base.where(F.pmod(F.xxhash64("kd", "tie"), F.lit(every)) == 0)
    held = segments(some, kind).groupBy("h").agg(F.count_distinct("kd", "tie").alias("k")).where(F.col("k") >= max(20, LOOKED_AT // 100))
    return np.sort(held.select("h").toArrow().column("h").to_numpy())


def fetched(base: DataFrame, wanted: DataFrame, small: bool = False) -> DataFrame:
    """Texts with the segments (h, start, n, many) that are wanted of them; small: so few that they are broadcast.

    The text side of the join has the columns and the partitioning of cut_documents, so that its shuffle is reused.
    """
    lists = wanted.groupBy("kd", "tie").agg(F.collect_list(F.struct("h", "start", "n", "many")).alias("wanted"))
    return base.join(F.broadcast(lists) if small else lists.hint("merge"), ["kd", "tie"]).select("doc_id", "text", "kd", "tie", "wanted")


def once(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices without the rows that repeat the document before them; a join sorts its rows by document."""
    last = None
    for batch in slices(batches, rows):
        kd, tie = batch.column("kd").to_numpy(), batch.column("tie").to_numpy()
        if not len(kd):
            continue
        new = np.ones(len(kd), dtype=bool)
        new[1:] = (kd[1:] != kd[:-1]) | (tie[1:] != tie[:-1])
        new[0] = last != (kd[0], tie[0])
        last = kd[-1], tie[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def different_places(table: pa.Table) -> pa.Table:
    """Rows of a table sorted by h without those at the place of another, which a repeated document brings."""
    cols = [table.column(c).to_numpy() for c in ("start", "tie", "kd", "h")]
    order = np.lexsort(cols)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)
    return table if new.all() else table.take(pa.array(np.sort(order[new])))


def wanted_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    """Row of each wanted segment and its fields."""
    lists = batch.column("wanted")
    sizes = lists.value_lengths().to_numpy()
    return sizes, [lists.flatten().field(c) for c in ("h", "start", "n", "many")]


def refined(texts: DataFrame, kind: Kind, level: int) -> DataFrame:
    """Segments of the wanted stretches, anchored by longer grams, all salted by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches, 64):
            sizes, (h, start, n, _) = wanted_of(batch)
            spans = iter(zip(h.to_pylist(), start.to_pylist(), n.to_pylist(), strict=True))
            parts = []
            for t, kd, tie, k in zip(texts_of(batch, "text"), batch.column("kd").to_pylist(), batch.column("tie").to_pylist(), sizes.tolist(), strict=True):
                values = kind.values(as_bytes(t))
                for above, a, count in itertools.islice(spans, k):
                    own, sh, first, got, again = segments_of(values[a : a + count + kind.width - 1], kind, level)
                    own = mix(own.view(np.uint64) ^ mix(np.array([above]).view(np.uint64))).view(np.int64)
                    parts.append((own, np.full(len(own), 1 + int(tie) % SALTS, dtype=np.int32), sh, np.full(len(own), kd), np.full(len(own), tie), (first + a).astype(np.int32), got.astype(np.int32), again))
            yield from segment_batch(parts)

    return texts.mapInArrow(run, SEGMENT)


# --- count-min sketch ---


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(values ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


def count_sketch(found: DataFrame, rows: int = 4, most_bits: int = MOST_BITS) -> Broadcast:
    """Count-min sketch of how often windows stand, counters saturating at two, as one bit a cell: two or more.

    Every window is counted at its anchor: an equal window brings an equal anchor, so the count of the anchor's cell
    is at least the count of any of its windows, and the sketch's estimate never falls below it. Each task sends its
    non-empty cells by blocks, blocks are merged in Spark, and the merged bitmaps go to all tasks. The number of
    cells follows the number of segments up to rows * 2^most_bits bits; with more the prefilter lets more through,
    at most all segments, which the exact pass is made for.
    """
    bits = min(most_bits, max(BLOCK_BITS, (4 * found.count()).bit_length()))

    def part(pending: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        got = np.concatenate(pending)
        for row in range(rows):
            cell, count = np.unique(cells(got, row, bits), return_counts=True)
            block = cell >> BLOCK_BITS
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(cell)]))
            offsets = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            twice = (count > 1).astype(np.uint8)
            spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row * (1 << (bits - BLOCK_BITS)) + int(block[s.start]) for s in spans], pa.int32()), pa.array([offsets[s].tobytes() for s in spans], pa.binary()), pa.array([np.packbits(twice[s]).tobytes() for s in spans], pa.binary())],
                names=["block", "cells", "twice"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0
        for batch in batches:
            h, again = batch.column("h").to_numpy().view(np.uint64), batch.column("again").to_numpy(zero_copy_only=False)
            pending += [h, h[again]]
            size += len(h)
            if size >= FLUSH:
                yield from part(pending)
                pending, size = [], 0
        if size:
            yield from part(pending)

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
        for c, t in zip(table.column("cells"), table.column("twice"), strict=True):
            at = np.frombuffer(c.as_py(), dtype=np.uint16)
            total[at] += 1 + np.unpackbits(np.frombuffer(t.as_py(), dtype=np.uint8), count=len(at))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

    merged = found.select("h", "again").mapInArrow(run, "block int, cells binary, twice binary").groupBy("block").applyInArrow(merge, "block int, bits binary").toArrow()
    maps = np.zeros((rows << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for block, packed in zip(merged.column("block").to_pylist(), merged.column("bits"), strict=True):
        maps[block] = np.frombuffer(packed.as_py(), dtype=np.uint8)
    return found.sparkSession.sparkContext.broadcast(maps.reshape(rows, -1))


def estimated_twice(maps: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the estimate of each anchor's windows is two or more: the smallest of its cells in all rows."""
    bits = int(maps.shape[1] * 8).bit_length() - 1
    ok = np.ones(len(values), dtype=bool)
    for row in range(len(maps)):
        cell = cells(values, row, bits)
        ok &= (maps[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def estimated_repeated(found: DataFrame, maps: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(estimated_twice(maps.value, batch.column("h").to_numpy().view(np.uint64))))

    return found.mapInArrow(run, SEGMENT)


# --- groups that stand together in a sorted partition ---


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000, weight: str | None = None) -> Iterator[pa.Table]:
    """Tables of some rows, or some weight, that end where the key changes; the input is sorted by the key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < (20_000 if weight else least):
            continue
        table = pa.Table.from_batches(held)
        values = table.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield from at_changes(table.slice(0, cut), key, least, weight)
            held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if rows:
        yield from at_changes(pa.Table.from_batches(held), key, least, weight)


def at_changes(table: pa.Table, key: str, least: int, weight: str | None) -> Iterator[pa.Table]:
    """Parts of about `least` rows or weight, cut where the sorted key changes."""
    values = table.column(key).to_numpy()
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    total = np.cumsum(table.column(weight).to_numpy().astype(np.int64))[ends - 1] if weight else ends
    at = done = 0
    while at < len(values):
        k = min(int(np.searchsorted(total, done + least)), len(ends) - 1)
        yield table.slice(at, int(ends[k]) - at)
        at, done = int(ends[k]), int(total[k])


def run_marks(kd: np.ndarray, tie: np.ndarray, start: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Marked windows (owner ascending, then place) as runs: kd, tie, start, n."""
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    of = owner[first]
    return pa.RecordBatch.from_arrays([pa.array(kd[of]), pa.array(tie[of]), pa.array((start[of] + place[first]).astype(np.int32)), pa.array(np.diff(np.append(first, len(owner))).astype(np.int32))], names=["kd", "tie", "start", "n"])


MARK = "kd long, tie long, start int, n int"
#: What is to be done with a segment: mark all its windows, compare them, deal them out by longer anchors, decide
#: again on what the parts of a salted anchor have left.
GONE, COMPARED, FINER, AGAIN = 0, 1, 2, 3
DECISION = SEGMENT + ", many boolean, what int"


class Decisions:
    """What is to be done with the segments of anchors that stream by in the order of segments_in_order."""

    def __init__(self, width: int, first_stays: bool, most: int, last: bool, most_rows: int):
        self.width, self.first_stays, self.most, self.last, self.most_rows = width, first_stays, most, last, most_rows

    def of(self, rows: dict[str, np.ndarray], before: bool, after: bool, whole: bool) -> pa.RecordBatch:
        """Decisions on rows of whole groups, or of a part of one that goes to longer anchors unseen.

        before, after: a row of the same group, which only shows what changes, stands at the beginning, at the end.
        """
        group, segment, place = (np.any([rows[c][1:] != rows[c][:-1] for c in cols], axis=0) for cols in (("h", "salt"), ("h", "salt", "sh"), ("kd", "tie", "start")))
        own = slice(int(before), len(rows["h"]) - int(after))
        first = np.append([True], segment)
        copy = ~first & np.append([False], place)
        # a first has copies if a row at another place follows before the next first
        firsts = np.flatnonzero(first)
        many = np.zeros(len(first), dtype=bool)
        many[firsts] = np.logical_or.reduceat(copy, firsts)
        starts = np.flatnonzero(np.append([True], group))
        number = np.cumsum(np.append([True], group)) - 1
        units = np.add.reduceat(np.where(first, rows["n"].astype(np.int64) + (self.width - 1), 0), starts)[number]
        several = (np.add.reduceat(first.astype(np.int64), starts) > 1)[number] | np.logical_or.reduceat(rows["again"], starts)[number]
        # of a group not seen whole the first copy goes along, lest it be the only one that shows that there are any
        copies = np.cumsum(copy)
        some = first | copy & (copies - copies[firsts][np.cumsum(first) - 1] == 1) & (not whole)
        again = some & (rows["salt"] > 0)
        finer = some & ~again & ((units > self.most) | (not whole)) & (not self.last)
        compared = some & ~again & ~finer & (several | (not whole))
        gone = copy | (many & (not self.first_stays))
        out = []
        names = [c.split()[0] for c in DECISION.split(", ")]
        for what, rows_of in ((GONE, gone), (COMPARED, compared), (FINER, finer), (AGAIN, again)):
            at = np.flatnonzero(rows_of[own]) + own.start
            out.append([*(rows[c][at] for c in names[:-2]), many[at], np.full(len(at), what, dtype=np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        held: list[pa.RecordBatch] = []
        count, cut = 0, False  # cut: the first held row has been decided on and its group goes on

        def arrays(table: pa.Table, a: int, b: int) -> dict[str, np.ndarray]:
            return {c: table.column(c).slice(a, b - a).to_numpy() for c in names}

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                count += batch.num_rows
                if count < self.most_rows:
                    continue
            if not count:
                continue
            table, n = pa.Table.from_batches(held), count
            keys = [table.column(c).to_numpy() for c in ("h", "salt")]
            changes = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            end = n if batch is None else int(changes[-1]) if len(changes) else 0
            at = 0
            if cut and end:  # the rest of a group that was too large to see whole
                at = int(changes[0]) if len(changes) else n
                yield self.of(arrays(table, 0, at), True, False, False)
                cut = False
            if end > at:
                yield self.of(arrays(table, at, end), False, False, True)
            if not end:
                yield self.of(arrays(table, 0, n), cut, True, False)
                end, cut = n - 2, True
            # after a cut the last two rows stay: one that shows what changes, one undecided
            held, count = table.slice(end).combine_chunks().to_batches(), n - end


def marked_windows(base: DataFrame, found: DataFrame, kind: Kind, compare: Callable[[DataFrame], DataFrame], first_stays: bool, most: int = GROUP_UNITS) -> DataFrame:
    """Runs of windows to remove (kd, tie, start, n), of all segments in found.

    Segments that stand at several places are marked at all of them (but for the first, if first_stays). The first
    place of each different segment is compared with those of the others of its anchor, unless it is the only one.
    What a salted anchor's parts leave is put together where a task can hold it, else dealt out by longer anchors.
    """
    decided = found.sparkSession.createDataFrame([], DECISION)
    last = len(kind.grams) - 1
    for level in range(last + 1):

        def decide(segments: DataFrame, level: int = level) -> DataFrame:
            order = segments.repartition("h", "salt").sortWithinPartitions("h", "salt", "sh", "kd", "tie", "start")
            return written(order.mapInArrow(Decisions(kind.width, first_stays, most, level == last, GROUP_ROWS), DECISION), f"segments-{level}")

        now = decide(found)
        decided = decided.unionByName(now)
        finer = now.where(f"what = {FINER}")
        left = now.where(f"what = {AGAIN}").drop("what", "many").withColumn("salt", F.lit(0))
        if not left.isEmpty():
            held = left.groupBy("h").agg(F.sum(F.col("n") + F.lit(kind.width - 1)).alias("units"))
            left = left.join(held, "h").withColumn("fits", (F.col("units") <= most) | F.lit(level == last))
            now = decide(left.where("fits").select(found.columns))
            finer = finer.unionByName(now.where(f"what = {FINER}")).select("h", "kd", "tie", "start", "n", "many").unionByName(left.where("NOT fits").select("h", "kd", "tie", "start", "n", F.lit(False).alias("many")))
            decided = decided.unionByName(now)
        if level == last or finer.isEmpty():
            break
        few = finer.count() <= FEW
        found = refined(fetched(base, finer, few), kind, level + 1)
    marks = decided.where(f"what = {GONE}").select("kd", "tie", "start", "n")
    return marks.unionByName(compare(fetched(base, decided.where(f"what = {COMPARED}"))))


# --- words: every window that stands twice anywhere goes ---

WINDOW_BASE = 0x8CB92BA72F3D8DD7


def windows_twice(texts: DataFrame) -> DataFrame:
    """Marks of windows that another window under their anchor equals; segments marked as a whole are left out."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches):
            sizes, (h, start, n, many) = wanted_of(batch)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            spans = iter(zip(start.to_pylist(), n.to_pylist(), strict=True))
            wh: list[bytes] = []
            for t, k in zip(texts_of(batch, "text"), sizes.tolist(), strict=True):
                windows = Rolling(WORDS.values(as_bytes(t)), WINDOW_BASE).windows(WORDS.width)
                wh += [windows[a : a + c].tobytes() for a, c in itertools.islice(spans, k)]
            yield pa.RecordBatch.from_arrays([h, batch.column("kd").take(rows), batch.column("tie").take(rows), start, n, many, pa.array(wh, pa.binary())], names=["h", "kd", "tie", "start", "n", "many", "wh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "h", 200_000, "n"):
            table = different_places(table)
            counts = table.column("n").to_numpy().astype(np.int64)
            w = np.frombuffer(b"".join(x.as_py() for x in table.column("wh")), dtype=np.uint64)
            owner = np.repeat(np.arange(len(counts)), counts)
            h = table.column("h").to_numpy()[owner]
            order = np.lexsort((w, h))
            same = (w[order][1:] == w[order][:-1]) & (h[order][1:] == h[order][:-1])
            hit = np.zeros(len(w), dtype=bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            hit &= ~table.column("many").to_numpy(zero_copy_only=False)[owner]
            place = np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield run_marks(*(table.column(c).to_numpy() for c in ("kd", "tie", "start")), owner[hit], place[hit])

    held = texts.mapInArrow(fetch, "h long, kd long, tie long, start int, n int, many boolean, wh binary")
    return held.repartition("h").sortWithinPartitions("h").mapInArrow(run, MARK)


def remove_repeated_words(docs: DataFrame, rows: int = 4, most_bits: int = MOST_BITS, most: int = GROUP_UNITS, keep: bool = False) -> DataFrame:
    """Drop every word that a window of 35 words covers whose words also start elsewhere.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text (null: none). Returns a row for each row of docs: doc_id,
    n_words, n_removed, kept (kept words joined by one space), kept_sha256. Windows are judged on the input. Documents
    under 35 words lose nothing; a null id is an id of its own; rows that repeat id and text are one document and
    don't repeat each other's windows (see keyed). Segments are told by 96 bits of hash (anchor and content), windows
    by 128 (anchor and window). With keep, the other columns of docs come along, but for those named like the new
    ones or kd, tie and marks.

    A count-min sketch, merged of the partitions' sketches, rules out windows estimated to stand once; the second
    pass groups the rest exactly and loses none (see count_sketch).
    """
    base = keyed(docs)
    whole = keyed(docs, *(c for c in docs.columns if c.lower() not in ("doc_id", "text", "kd", "tie", "marks", "n_words", "n_removed", "kept", "kept_sha256"))) if keep else base
    found = written(segments(base, WORDS, common_anchors(base, WORDS)), "word-segments")
    found = estimated_repeated(found, count_sketch(found, rows, most_bits))
    marks = marked_windows(base, found, WORDS, windows_twice, False, most)

    def cut(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple:
        a, b = word_bounds(raw)
        gone = covered(len(a), starts, counts + (WORDS.width - 1))
        whole = raw.tobytes()
        kept = b" ".join([whole[x:y] for x, y in zip(a[~gone].tolist(), b[~gone].tolist(), strict=True)])
        return len(a), int(gone.sum()), kept

    return cut_documents(whole, marks, cut, "n_words long, n_removed long", keep=keep)


# --- bytes: every window that also starts earlier goes ---


def common_with_smaller(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order its common prefix with the previous place of smaller rank (0 where none is).

    lcp[k] is the common prefix of places k - 1 and k. All places chase pointers together: if the place pointed to
    isn't smaller, nothing between it and where it points itself is either. Pointers whose common prefix has come
    to nothing are given up.
    """
    before, common = np.arange(-1, len(rank) - 1), lcp.copy()
    open_ = np.flatnonzero(common > 0)
    open_ = open_[rank[before[open_]] > rank[open_]]
    while len(open_):
        j = before[open_]
        common[open_] = np.minimum(common[open_], common[j])
        before[open_] = before[j]
        open_ = open_[(common[open_] > 0) & (before[open_] >= 0)]
        open_ = open_[rank[before[open_]] > rank[open_]]
    common[before < 0] = 0
    return common


def longest_previous_factors(suffixes: np.ndarray, rank: np.ndarray, prefix: int = 0) -> np.ndarray:
    """Longest previous factor of each suffix: its longest common prefix with any suffix of smaller rank.

    Suffixes are rows of bytes, cut at a width; the first `prefix` bytes name a group and don't count. Suffix array,
    common prefixes of neighbours, and previous and next smaller ranks in suffix order (Crochemore and Ilie).
    """
    n, width = suffixes.shape
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable") if n else np.zeros(0, dtype=np.int64)
    lcp = np.zeros(n, dtype=np.int64)
    for a in range(1, n, 1 << 15):
        b = min(n, a + (1 << 15))
        differ = suffixes[order[a - 1 : b - 1]] != suffixes[order[a:b]]
        lcp[a:b] = np.maximum(np.where(differ.any(axis=1), differ.argmax(axis=1), width) - prefix, 0)
    ranks = rank[order]
    before = common_with_smaller(ranks, lcp)
    after = common_with_smaller(ranks[::-1], np.concatenate((lcp[:1], lcp[1:][::-1])))[::-1]
    out = np.zeros(n, dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def earlier_factors(bodies: list[bytes], anchor: np.ndarray, position: tuple[np.ndarray, ...], most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a previous factor of full length: (segment, window) numbers, ascending.

    The windows are the suffixes of the segments, cut at the window length. Those whose hash stands alone under
    their anchor have no factor of that length and are left out; the others are taken in portions of about `most`
    that keep equal hashes together. Their rank is their place in the corpus.
    """
    size = BYTES.width
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    ends, begin = np.cumsum(sizes - size + 1), np.cumsum(sizes) - sizes
    key = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint64)
    cuts = [*range(0, len(bodies), 2000), len(bodies)]
    for a, b in itertools.pairwise(cuts):
        counts = sizes[a:b] - size + 1
        owner = np.repeat(np.arange(a, b), counts)
        at = np.arange(len(owner)) + np.repeat(begin[a:b] - begin[a] - (np.cumsum(counts) - counts), counts)
        part = Rolling(byte_values(text[begin[a] : begin[b - 1] + sizes[b - 1]]), BYTE_BASE).windows(size)[at]
        key[ends[a] - counts[0] : ends[b - 1]] = part ^ mix(anchor.view(np.uint64))[owner]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    some = order[np.append(same, False) | np.append([False], same)] if len(key) else order
    heads = np.append(np.flatnonzero(np.append([True], key[some[1:]] != key[some[:-1]])), len(some)) if len(some) else np.zeros(1, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(text, size) if len(some) else text
    found = [np.zeros((2, 0), dtype=np.int64)]
    a = 0
    while a < len(some):
        b = int(heads[min(np.searchsorted(heads, a + most), len(heads) - 1)])
        owner = np.searchsorted(ends, some[a:b], side="right")
        place = some[a:b] - (ends[owner] - sizes[owner] + size - 1)
        names = anchor[owner].astype(">i8").view(np.uint8).reshape(-1, 8)
        suffixes = np.concatenate((names, windows[begin[owner] + place]), axis=1)
        by = np.lexsort((position[2][owner] + place, *(p[owner] for p in position[1::-1])))
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        hit = longest_previous_factors(suffixes, rank, 8) >= size
        found.append(np.stack((owner[hit], place[hit])))
        a = b
    owner, place = np.concatenate(found, axis=1)
    by = np.lexsort((place, owner))
    return owner[by], place[by]


def windows_before(texts: DataFrame) -> DataFrame:
    """Marks of the windows of wanted segments that also start earlier."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches):
            sizes, (h, start, n, _) = wanted_of(batch)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            ends = (start.to_numpy().astype(np.int64) + n.to_numpy() + (BYTES.width - 1)).tolist()
            spans = iter(zip(start.to_pylist(), ends, strict=True))
            bodies: list[bytes] = []
            for t, k in zip(texts_of(batch, "text"), sizes.tolist(), strict=True):
                bodies += [t[a:b] for a, b in itertools.islice(spans, k)]
            yield pa.RecordBatch.from_arrays([h, batch.column("kd").take(rows), batch.column("tie").take(rows), start, n, pa.array(bodies, pa.binary())], names=["h", "kd", "tie", "start", "n", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "h", 120_000, "n"):
            table = different_places(table)
            bodies = [b.as_py() for b in table.column("body")]
            position = tuple(table.column(c).to_numpy() for c in ("kd", "tie", "start"))
            yield run_marks(*position, *earlier_factors(bodies, table.column("h").to_numpy(), position))

    held = texts.mapInArrow(fetch, "h long, kd long, tie long, start int, n int, body binary")
    return held.repartition("h").sortWithinPartitions("h").mapInArrow(run, MARK)


def remove_later_bytes(docs: DataFrame, most: int = GROUP_UNITS) -> DataFrame:
    """Drop every byte that a string of 100 bytes covers which also starts earlier.

    Texts are UTF-8 bytes (null: empty), matches don't cross documents, earlier is a smaller (doc_id, start). Returns
    a row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary), kept_sha256.
    Texts under 100 bytes lose nothing; a null id is smaller than all others; rows that repeat id and text are one
    document (see keyed); other columns are never read. A copy of a segment is told by 96 bits of hash (anchor and
    content), windows of different segments by their bytes. Long texts count whole.
    """
    base = keyed(docs)
    found = segments(base, BYTES, common_anchors(base, BYTES))
    marks = marked_windows(base, found, BYTES, windows_before, True, most)

    def cut(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple:
        gone = covered(len(raw), starts, counts + (BYTES.width - 1))
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        return len(raw), int(gone.sum()), spans, raw[~gone].tobytes()

    return cut_documents(base, marks, cut, "n_bytes long, n_removed long, n_spans long", "binary")


# --- both: back to the documents ---


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places within one of the stretches."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + sizes, n), -1)
    return np.cumsum(step[:n]) > 0


def cut_documents(base: DataFrame, marks: DataFrame, cut: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], counts: str, kind: str = "string", keep: bool = False) -> DataFrame:
    """Join the marked runs of windows of each document to its text and cut; marks: kd, tie, start, n.

    With keep, all columns of base but the keys come along, else only the id.
    """
    by_doc = marks.groupBy("kd", "tie").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    names = [c.split()[0] for c in counts.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for t, m in zip(texts_of(batch, "text"), batch.column("marks"), strict=True):
                start, n = (m.values.field(c).to_numpy().astype(np.int64) if m.is_valid else np.zeros(0, dtype=np.int64) for c in ("start", "n"))
                out.append(cut(as_bytes(t), start, n))
            cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(len(names))]
            kept = [o[-1] for o in out]
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            body = pa.array(kept, pa.binary()) if kind == "binary" else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *cols, body, pa.array(sha)], names=[*own, *names, "kept", "kept_sha256"])

    own = [c for c in base.columns if c not in ("kd", "tie")] if keep else ["doc_id"]
    kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in own)
    joined = base.join(by_doc, ["kd", "tie"], "left").select(*dict.fromkeys([*own, "text"]), "marks")
    return joined.mapInArrow(run, f"{kinds}, {counts}, kept {kind}, kept_sha256 string")
