"""Near copies by Jaccard similarity of word shingles: parity sketches, pigeonhole keys per size band, exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, slices, stored, texts_of, written
from .repeats import keyed, whole_groups
from .text import LOWER, as_bytes, mix, shingles, word_bounds, word_hashes

#: Bits of one sketch block, as a power of two, and blocks for each difference that two sets of a band may have. A block
#: holds some three tokens; with 4096 places for them, texts that share nothing had equal blocks, whose number grew with
#: the square of the table.
BLOCK_BITS = 32
SLACK = 1.4
#: Shingles and sets that one cell of a candidate group holds on each side.
CELL_SHINGLES = 400_000
CELL_SETS = 1000
#: The same where only sketches are compared, which have a bit or two for each shingle.
SKETCH_SHINGLES = 16_000_000
SKETCH_SETS = 4000
#: Bits of the map that keeps other texts out of a shuffle (16 MB); a fuller one lets more through, at most all.
MOST_MAP_BITS = 27
BAND = 2.0


def shingle_set(raw: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, A-Z lower-cased."""
    low = LOWER[raw]
    return np.unique(shingles(word_hashes(low, *word_bounds(low)), size))


def band_edges(most: int = 1 << 31) -> list[int]:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


EDGES = np.array(band_edges(), dtype=np.int64)
ZOBRIST = np.uint64(0x9E3779B97F4A7C15)


def most_different(total: int | np.ndarray, p: int, q: int) -> int | np.ndarray:
    """Largest symmetric difference of two sets whose sizes add up to `total` and whose similarity is >= p/q."""
    return total * (q - p) // (q + p)


def parity_blocks(tokens: np.ndarray, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR of the codes of the bits that stand in each block of the parity sketch, and their number.

    Each token flips one bit of one block, so the Hamming distance of two sketches is at most the symmetric
    difference, and all blocks are equal but for as many as there are differences.
    """
    g = mix(tokens ^ np.uint64(seed))
    shift, low = np.uint64(BLOCK_BITS), np.uint64((1 << BLOCK_BITS) - 1)
    at, count = np.unique((g >> np.uint64(32)) % np.uint64(blocks) << shift | g & low, return_counts=True)
    at = at[count % 2 == 1]
    owner = (at >> shift).astype(np.int64)
    number = np.bincount(owner, minlength=blocks)
    value = np.zeros(blocks, dtype=np.uint64)
    if len(at):
        first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
        value[owner[first]] = np.bitwise_xor.reduceat(mix(((at & low) + np.uint64(1)) * ZOBRIST), first)
    return value, number


def keys_of(tokens: np.ndarray, p: int, q: int) -> np.ndarray:
    """Pigeonhole keys of a set: its size band, and the next band if a larger partner may stand there.

    A band has a number of blocks that all its sets share. A set and any partner differ in at most d tokens, d by the
    set's own size, so at most d blocks differ and the set may pass over all but d + 1 blocks: first those with the
    fewest bits, which tell least, then those with the lowest number. No linked pair is lost: of its equal blocks,
    which have equal bits and so stand in the same order for both, the last one is passed over by neither, since
    more equal blocks than either passes over come before it or are it. A block with no or one bit that has to be
    used after all gets a key for each block of a second sketch, of which one is equal too.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    largest = n * q // p
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    out = []
    for b in (band, band + 1) if largest >= EDGES[band + 1] else (band,):
        top = int(EDGES[b + 1]) - 1
        d = int(most_different(n + min(top, largest), p, q))
        if d == 0:
            continue
        most = int(most_different(2 * top, p, q))
        blocks = int(SLACK * (most + 1))
        value, number = parity_blocks(tokens, blocks, 2 * b + 1)
        used = np.argsort(number, kind="stable")[blocks - d - 1 :]
        key = mix(value[used] ^ mix(used.astype(np.uint64) + np.uint64((b + 1) << 32)))
        poor = number[used] <= 1
        out.append(key[~poor])
        if poor.any():
            second, _ = parity_blocks(tokens, most + 1, 2 * b + 2)
            second = mix(second + np.arange(1, most + 2, dtype=np.uint64))
            out.append(mix(key[poor][:, None] ^ second[None, :]).ravel())
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def class_code(tokens: np.ndarray) -> int:
    """64-bit code of a set, from its size, XOR and sum."""
    with np.errstate(over="ignore"):
        x = mix(tokens)
        code = mix(np.array([np.bitwise_xor.reduce(x)], dtype=np.uint64) ^ mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(x))], dtype=np.uint64)))
    return int(code.view(np.int64)[0])


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: a power of two of bits, more than one and at most two a token, 64 at least."""
    bits = max(64, 1 << len(tokens).bit_length())
    flips = np.bincount((mix(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits) if len(tokens) else np.zeros(bits, dtype=np.int64)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64)


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits: a token's bit is its hash modulo the number of bits."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def close_pairs(sketches: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, p: int, q: int, alike: bool) -> Iterator[tuple[int, int]]:
    """Pairs of one cell that sizes and sketches let be linked: enough of them that all such sets are connected.

    The Hamming distance of two sketches is a lower bound of the difference, so no linked pair is left out.
    """
    order = np.argsort(sizes, kind="stable")
    n, sides = sizes[order].astype(np.int64), side[order]
    widths = np.array([len(sketches[k]) for k in order], dtype=np.int64)
    ends = np.searchsorted(n, n * q // p, side="right")
    root = np.arange(len(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for width in np.unique(widths).tolist():
        a, b = np.searchsorted(widths, (width, width + 1)).tolist()
        most = int(ends[b - 1])
        near = [np.stack([sketches[k] for k in order[a:b]])]
        at = b
        while at < most:  # larger sets in sketches of the same number of bits
            wide = int(np.searchsorted(widths, widths[at], side="right"))
            rows = np.stack([sketches[k] for k in order[at : min(wide, most)]])
            while rows.shape[1] > width:
                rows = folded(rows)
            near.append(rows)
            at = min(wide, most)
        rows = np.concatenate(near)
        for i in range(a, b):
            js = np.arange(i + 1, ends[i])
            if not alike:
                js = js[sides[js] != sides[i]]
            if not len(js):
                continue
            far = np.bitwise_count(rows[js - a] ^ rows[i - a]).sum(axis=1)
            for j in js[far <= most_different(n[i] + n[js], p, q)].tolist():
                if (x := find(i)) != (y := find(j)):
                    root[y] = x
                    yield int(order[i]), int(order[j])


def sharing(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Links a, b of sets that share a key, of rows (key, n, code) in that order.

    A key's sets are cut where the next is too large to be linked with any before; a part's sets are linked to its
    first. Nothing is held but the last row, however many sets share a key.
    """
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, code = (batch.column(c).to_numpy() for c in ("key", "n", "code"))
        if last is not None:
            key, n, code = (np.append(np.array([x], dtype=np.int64), c) for x, c in zip(last, (key, n, code), strict=True))
        new = np.append([True], (key[1:] != key[:-1]) | (n[:-1] * q < n[1:] * p))
        head = code[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        last = int(key[-1]), int(n[-1]), int(head[-1])
        pairs = np.unique(np.stack((code, head), axis=1)[code != head], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def dealt(chosen: DataFrame, p: int, q: int, most_sets: int, most_shingles: int) -> DataFrame:
    """Members of blocks (code, block, n, ...) with their step, chunk and near, the steps to compare with.

    A block larger than a cell is split by set size, so that only sizes whose sets may be linked meet, and a size with
    very many sets into chunks.
    """
    whole = chosen.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    fits = (F.col("sets") <= most_sets) & (F.col("total") <= most_shingles)
    steps = F.floor(F.log("n") / math.log(q / p)).cast("int") if p < q else F.col("n").cast("int")
    member = chosen.join(whole, "block").withColumn("step", F.when(fits, 0).otherwise(steps))
    chunks = F.ceil(F.greatest(F.sum("n") / most_shingles, F.count("*") / most_sets)).cast("int")
    parts = member.groupBy("block", "step").agg(chunks.alias("chunks"))
    row = Window.partitionBy("block").orderBy("step")  # one row for each size step of a block
    own = F.struct("step", "chunks")
    around = F.array(F.lag(own).over(row), own, F.lead(own).over(row))
    parts = parts.withColumn("near", F.filter(around, lambda x: F.abs(x["step"] - F.col("step")) <= 1))
    return member.drop("sets", "total").join(parts, ["block", "step"]).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))


def in_cells(member: DataFrame, *held: str) -> DataFrame:
    """A row for each cell that a member of dealt takes part in: cell, alike, code, chunk and the columns held."""
    own = member.select("code", "block", *held, F.struct("step", "chunk").alias("own"), F.explode("near").alias("other"))
    own = own.withColumn("with", F.explode(F.transform(F.sequence(F.lit(0), F.col("other.chunks") - 1), lambda k: F.struct(F.col("other.step").alias("step"), k.alias("chunk")))))
    cell = F.xxhash64("block", F.least("own", "with"), F.greatest("own", "with")).alias("cell")
    return own.select(cell, (F.col("own") == F.col("with")).alias("alike"), "code", F.xxhash64("own").alias("chunk"), *held)


def likely(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of docs (kd, tie, ...) whose key may stand in members; no row of members is lost, some others stay.

    A bit map of bounded size, made and looked up by Spark, spares other texts the shuffle.
    """
    bits = 1 << min(MOST_MAP_BITS, max(16, (16 * members.count()).bit_length()))
    spot = F.pmod(F.xxhash64("kd", "tie"), F.lit(bits))
    bucket, place = F.shiftright(spot, 15).alias("bucket"), spot.bitwiseAND(F.lit((1 << 15) - 1))
    maps = members.select(bucket, place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map"))
    there = docs.select("*", bucket, place.alias("place")).join(F.broadcast(maps), "bucket")
    return there.where("getbit(cast(conv(hex(substring(map, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) = 1").select(docs.columns)


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, p: int, q: int, alike: bool) -> Iterator[tuple[int, int]]:
    """Links that join the sets of one cell: enough of them that linked sets are connected.

    Pairs within the size bound are compared by parity sketch first, whose Hamming distance is a lower bound of
    the difference; pairs already connected are skipped; the rest is counted exactly.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    words = max(16, int(most_different(2 * int(sizes[-1]), p, q)) // 4 + 1)
    sketch = np.zeros((len(sets), words * 64), dtype=np.uint8)
    for row, k in enumerate(order):
        np.bitwise_xor.at(sketch[row], (mix(sets[k]) % np.uint64(words * 64)).astype(np.int64), 1)
    packed = np.packbits(sketch, axis=1).view(np.uint64)
    del sketch
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sides = side[order]
    ends = np.searchsorted(sizes, sizes * q // p, side="right")
    for i in range(len(sets)):
        js = np.arange(i + 1, ends[i])
        if not alike:
            js = js[sides[js] != sides[i]]
        if not len(js):
            continue
        far = np.bitwise_count(packed[js] ^ packed[i]).sum(axis=1)
        for j in js[far <= most_different(sizes[i] + sizes[js], p, q)].tolist():
            if (a := find(i)) != (b := find(j)):
                both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                if q * both >= p * (sizes[i] + sizes[j] - both):
                    root[b] = a
                    yield int(order[i]), int(order[j])


def near_components(docs: DataFrame, size: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """Groups of documents linked by Jaccard similarity >= p/q of their distinct word shingles.

    Returns a row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links). A-Z
    are lower-cased, words are `[^\\x20\\x09-\\x0D]+`; a text with fewer words than a shingle is one shingle; null
    and empty texts have none and link with nothing. Equal sets are one class, whatever their number. Rows with a
    null id take part; a component without any id is null. Long texts count whole.

    Columns of docs besides id and text are never read. Candidate classes share a pigeonhole key. They are joined to
    blocks by linking each member of a key to the key's smallest member (never all pairs). A block's classes are
    compared cell by cell (see dealt), each pair of chunks a cell of bounded sets and shingles: first by sketch, whose
    links join smaller blocks, then exactly. Only texts of blocks with two classes or more are shuffled. Sets and
    classes are told by 64-bit hashes.
    """
    base = keyed(docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(as_bytes(t), size) for t in texts_of(batch, "text")]
            codes = np.array([class_code(s) for s in sets], dtype=np.int64)
            new = np.zeros(len(sets), dtype=bool)
            new[np.unique(codes, return_index=True)[1]] = True  # of equal sets in a slice one has keys
            keys = [keys_of(s, p, q) if k else np.zeros(0, dtype=np.uint64) for s, k in zip(sets, new.tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("kd"), batch.column("tie"), pa.array([len(s) for s in sets], pa.int64()), pa.array(codes), pa.array([sketch_of(s).tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)) if keys else pa.array([], pa.int64()))],
                names=["doc_id", "kd", "tie", "n_shingles", "code", "sketch", "keys"],
            )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    with_keys, keys_at = stored(base.mapInArrow(describe, f"doc_id {id_kind}, kd long, tie long, n_shingles long, code long, sketch binary, keys array<long>"), "set-keys")
    known = written(with_keys.drop("keys"), "sets")
    keys = with_keys.select(F.explode("keys").alias("key"), F.col("n_shingles").alias("n"), "code")
    shared = keys.repartition("key").sortWithinPartitions("key", "n", "code").mapInArrow(lambda batches: sharing(batches, p, q), "a long, b long")
    coarse = connected_components(shared).select(F.col("id").alias("code"), F.col("component").alias("block"))
    discard(docs.sparkSession, keys_at)

    first = known.join(coarse, "code").groupBy("code", "block").agg(F.min(F.struct("kd", "tie")).alias("at"), F.max("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"))
    sketched, sketches_at = stored(first.select("code", "block", "n", "at.kd", "at.tie", "sketch"), "coarse-blocks")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 2000):
            cell = table.column("cell").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            code, chunk, n = (table.column(c).to_numpy() for c in ("code", "chunk", "n"))
            alike, sketch = table.column("alike").to_numpy(), table.column("sketch").to_pylist()
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    out += [(code[a + i], code[a + j]) for i, j in close_pairs([np.frombuffer(x, dtype=np.uint64) for x in sketch[a:b]], n[a:b], chunk[a:b], p, q, bool(alike[a]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    close = in_cells(dealt(sketched, p, q, SKETCH_SETS, SKETCH_SHINGLES), "n", "sketch").repartition("cell").sortWithinPartitions("cell").mapInArrow(near, "a long, b long")
    blocks = connected_components(close).select(F.col("id").alias("code"), F.col("component").alias("block"))
    chosen = written(sketched.drop("block", "sketch").join(blocks, "code"), "blocks")
    discard(docs.sparkSession, sketches_at)
    member = dealt(chosen, p, q, CELL_SETS, CELL_SHINGLES)
    # the members' number grows with the input, so they are never broadcast, however few they are here
    texts = likely(base.select("kd", "tie", "text"), chosen).join(member.hint("merge"), ["kd", "tie"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(as_bytes(t), size).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("code", "block", "step", "chunk", "near")), pa.array(sets, pa.binary())], names=["code", "block", "step", "chunk", "near", "tokens"])

    near_kind = "array<struct<step: int, chunks: int>>"
    held = texts.select("text", "code", "block", "step", "chunk", "near").mapInArrow(cells, f"code long, block long, step int, chunk int, near {near_kind}, tokens binary")
    held = in_cells(held, "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 200):
            cell = table.column("cell").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            code, chunk = table.column("code").to_numpy(), table.column("chunk").to_numpy()
            alike = table.column("alike").to_numpy()
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                _, first = np.unique(code[a:b], return_index=True)
                if len(first) > 1:
                    sets = [np.frombuffer(table.column("tokens")[a + int(k)].as_py(), dtype=np.uint64) for k in first]
                    out += [(code[a + first[i]], code[a + first[j]]) for i, j in similar_pairs(sets, chunk[a + first], p, q, bool(alike[a]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    links = held.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")
    linked = connected_components(links).select(F.col("id").alias("code"), "component")
    named = known.select("doc_id", "n_shingles", "code").join(linked, "code", "left")
    # empty sets stand alone, each row for itself
    named = named.withColumn("component", F.coalesce("component", "code")).withColumn("alone", F.when(F.col("n_shingles") == 0, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    smallest = named.groupBy("component", "alone").agg(F.min("doc_id").alias("component_id"))
    same = (named["component"] == smallest["component"]) & named["alone"].eqNullSafe(smallest["alone"])
    return named.join(smallest, same).select(named["doc_id"], "n_shingles", "component_id")
