"""Merkle manifest of a dataset: leaves, subroots of sources, one root, and inclusion proofs by octopus multiproofs.

Nodes of a level are joined in runs of 16, in order; each run's digest is a node of the next level. Every source has a
tree of its own over its leaves, and the subroots are the leaves of a last tree. Digests are joined as lowercase hex.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored, written

ARITY = 16
#: Levels below which a block of leaves has its whole subtree, and leaves that one leaf partition holds (but for a block).
BLOCK_LEVELS = 2
PARTITION = 8192
#: Number of the tree over the subroots; those of the sources are numbered from 0.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def depth(n: int) -> int:
    """Levels of a tree over n leaves above its leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def leaf_of(**other: Column) -> Column:
    """SHA-256 of the fields of a row; other columns may stand in for those of the same name."""

    def part(name: str) -> Column:
        value = other.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in FIELDS)), 256)


@dataclass
class Manifest:
    """A tree over documents: leaves (doc_id, leaf, tampered, src, pos, n, part), nodes (tree, level, pos, digest) above
    blocks, spans (part, tree, base, lo, hi, n) of the nodes that each leaf partition derives, subroots (source, src, n,
    subroot), the root (None of an empty table), the number of sources, of levels of the largest, and of those in blocks."""

    leaves: DataFrame
    nodes: DataFrame
    spans: DataFrame
    subroots: DataFrame
    root: str | None
    sources: int
    levels: int
    base: int


def ordered_leaves(docs: DataFrame, tampered: Column | None) -> DataFrame:
    """Leaves in the order of (source, doc_id), nulls first; rows that share an id by digest: at is partition and place.

    Each text is read once; what is sorted is digests. Rows that are equal throughout are told apart by the place where
    they were read, so that no range partition has to hold all of them.
    """
    names = [c for c in FIELDS if c != "text"]
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, F.unhex(leaf_of(text=F.translate("text", UPPER, LOWER))))
    rows = docs.select(*FIELDS).select(*names[:2], F.unhex(leaf_of()).alias("leaf"), changed.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    rows, at = stored(rows, "merkle-leaves")
    keys, n = ["source", "doc_id", "leaf", "tie"], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("source", "doc_id", "leaf", "tampered", F.monotonically_increasing_id().alias("at"))
    out = written(out, "merkle-sorted")
    discard(docs.sparkSession, at)
    return out


def numbered_sources(counts: DataFrame) -> DataFrame:
    """Sources (source, n) in order, null first and bytewise: number src and sum of the leaves before them, start."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(counts.repartitionByRange(n, "source").sortWithinPartitions("source").withColumn("at", F.monotonically_increasing_id()), "merkle-sources")
    rows = rows.withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    ranges = rows.groupBy("range").agg(F.count("*").alias("sources"), F.sum("n").alias("held"))  # a row for each range partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("sources", "held")))
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, "range")
    return rows.select("source", "n", (F.col("sources") + F.col("place")).alias("src"), (F.col("held") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))


def parents(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, n, pos, digest) of the next level."""
    run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    up = nodes.groupBy("tree", "n", F.expr(f"pos div {ARITY}").alias("up")).agg(run.alias("run"))
    return up.select("tree", "n", F.col("up").alias("pos"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"))


def hashed_runs(row: bytes) -> bytes:
    """Digests, as hex laid end to end, of the runs of such a row of nodes."""
    step = 64 * ARITY
    return hexlify(b"".join(hashlib.sha256(row[k : k + step]).digest() for k in range(0, len(row), step)))


def build(docs: DataFrame, tampered: Column | None = None, block_levels: int = BLOCK_LEVELS, partition: int = PARTITION) -> Manifest:
    """The tree over all rows of docs (doc_id, source, lang, n_chars, text; other columns aren't read).

    Leaves of a source ascend by doc_id, null first, and by digest among rows that share an id; rows that repeat are
    leaves each. Null fields and null sources count as values; texts count whole. tampered names rows for which a leaf
    with the text's A-Z in lower case is kept beside the true one.

    Every leaf's place comes from a range sort of digests and counts for each (range, source), so that a source of any
    size is spread. Blocks of 256 leaves are hashed up to their highest node where they lie; the levels above, 1/256
    of the leaves, are joined level by level. The driver gets the largest source's size, the number of sources and the root.
    """
    block = ARITY**block_levels

    def block_root(key: tuple, rows: pa.Table) -> pa.Table:
        """The highest node of a block: its source's subroot if it holds the whole source."""
        rows = rows.sort_by("pos")
        n = rows.column("n")[0].as_py()
        nodes = hexlify(b"".join(rows.column("leaf").to_pylist()))
        for _ in range(min(block_levels, depth(n))):
            nodes = hashed_runs(nodes)
        return pa.table({"tree": [key[0].as_py()], "n": [n], "pos": [key[1].as_py()], "digest": [nodes.decode()]})

    leaves = ordered_leaves(docs, tampered).withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    held = leaves.groupBy("source", "range").agg(F.count("*").alias("held"), F.min("place").alias("first"))
    held = written(held, "merkle-ranges")
    sources = written(numbered_sources(held.groupBy("source").agg(F.sum("held").alias("n"))), "merkle-sources")
    most, number = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("source", "range", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    offset = offset.join(sources, offset["source"].eqNullSafe(sources["source"])).select(offset["source"].alias("of"), F.col("range").alias("in"), "offset", "src", "start", "n")
    placed = leaves.join(offset, leaves["source"].eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    pos = F.col("place") + F.col("offset")
    placed = placed.select("doc_id", "leaf", "tampered", "src", "n", pos.alias("pos"), F.expr(f"(place + offset) div {block}").alias("block"), "start")
    placed = placed.withColumn("part", F.expr(f"(start + block * {block}) div {partition}")).drop("start")

    kind = "tree long, n long, pos long, digest string"
    level = written(placed.select(F.col("src").alias("tree"), "block", "pos", "n", "leaf").groupBy("tree", "block").applyInArrow(block_root, kind), "merkle-blocks")
    whole, levels = [level.where(f"n <= {block}")], depth(most)
    nodes = [level.where(f"n > {block}").withColumn("level", F.lit(block_levels))]
    level = nodes[0].drop("level")
    for k in range(block_levels + 1, levels + 1):
        level = written(parents(level), "merkle-nodes")
        whole.append(level.where(f"n <= {ARITY**k}"))
        level = level.where(f"n > {ARITY**k}")
        nodes.append(level.withColumn("level", F.lit(k)))
    roots = whole[0]
    for w in whole[1:]:
        roots = roots.unionByName(w)
    subroots = written(sources.join(roots.select(F.col("tree").alias("src"), F.col("digest").alias("subroot")), "src"), "merkle-subroots")

    level = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(number).cast("long").alias("n"), F.col("src").alias("pos"), F.col("subroot").alias("digest"))
    top_levels = depth(number)
    for k in range(top_levels):
        nodes.append(level.withColumn("level", F.lit(k)))
        level = written(parents(level), "merkle-nodes")
    found = level.first()
    all_nodes = nodes[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)

    # what each leaf partition derives: blocks of its sources, and subroots of all its sources
    spans = sources.withColumn("last", F.expr(f"(n - 1) div {block}"))
    spans = spans.withColumn("part", F.explode(F.expr(f"sequence(start div {partition}, (start + last * {block}) div {partition})")))
    first = lambda p: F.ceil(((F.col("part") + p) * partition - F.col("start")) / block).cast("long")
    spans = spans.select("part", "src", F.greatest(F.lit(0).cast("long"), first(0)).alias("lo"), F.least("last", first(1) - 1).alias("hi"), "n").where("lo <= hi")
    below = spans.select("part", F.col("src").alias("tree"), F.lit(block_levels).alias("base"), "lo", "hi", "n")
    over = spans.groupBy("part").agg(F.min("src").alias("lo"), F.max("src").alias("hi"))
    over = over.select("part", F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("base"), "lo", "hi", F.lit(number).cast("long").alias("n"))
    return Manifest(placed, all_nodes.drop("n"), below.unionByName(over), subroots.select("source", "src", "n", "subroot"), found and found["digest"], number, levels, block_levels)


def missing(tree: Manifest) -> DataFrame:
    """Coordinates (part, tree, level, pos) of the nodes that the leaf partitions need and can't derive, each once.

    A partition derives all nodes over its own span; of each level's runs at the span's two ends it lacks the others
    at most, for once they are fetched the run's parent is derived, too.
    """
    most = max(tree.levels, depth(tree.sources))
    scale = f"cast(power({ARITY}, level - base) as long)"
    rows = tree.spans.withColumn("level", F.explode(F.sequence("base", F.greatest(F.col("base"), F.lit(most)))))
    rows = rows.selectExpr("part", "tree", "level", f"lo div {scale} AS lo", f"hi div {scale} AS hi", f"cast((n + power({ARITY}, level) - 1) as long) div cast(power({ARITY}, level) as long) AS nodes").where("nodes > 1")
    left = f"if(lo % {ARITY} > 0, sequence(lo - lo % {ARITY}, lo - 1), array())"
    end = f"least(hi - hi % {ARITY} + {ARITY - 1}, nodes - 1)"
    right = f"if(hi < {end}, sequence(hi + 1, {end}), array())"
    return rows.select("part", "tree", "level", F.explode(F.expr(f"concat({left}, {right})")).alias("pos"))


class Levels:
    """The rows of nodes over consecutive leaves of a tree, with what was fetched at both ends, as hex laid end to end."""

    def __init__(self, row: bytes, start: int, n: int, fetched: dict[tuple[int, int], str]):
        self.rows: list[tuple[int, bytes]] = []
        self.n, level = n, 0
        while n > 1:
            first, end = start - start % ARITY, start + len(row) // 64
            last = min(-(-end // ARITY) * ARITY, n)
            row = "".join(fetched[level, k] for k in range(first, start)).encode() + row + "".join(fetched[level, k] for k in range(end, last)).encode()
            self.rows.append((first, row))
            row, start, n, level = hashed_runs(row), first // ARITY, -(-n // ARITY), level + 1
        self.top, self.top_at = row, start
        self.paths: dict[tuple[int, int], tuple] = {}

    def run(self, level: int, k: int) -> tuple[bytes, bytes]:
        """The nodes before and after node k in its run."""
        first, row = self.rows[level]
        at, start = 64 * (k - first), 64 * (k - k % ARITY - first)
        return row[start:at], row[at + 64 : start + 64 * ARITY]

    def path(self, k: int, level: int = 0) -> tuple:
        """Those pairs from node k up to the root of this tree; shared above."""
        if level == len(self.rows):
            return ()
        if not level:
            return (self.run(0, k), *self.path(k // ARITY, 1))
        if (level, k) not in self.paths:
            self.paths[level, k] = (self.run(level, k), *self.path(k // ARITY, level + 1))
        return self.paths[level, k]


def folded(leaf: bytes, path: tuple) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = hashlib.sha256(before + leaf + after).hexdigest().encode()
    return leaf


def proofs(tree: Manifest, keep: tuple[str, ...] = ("siblings",)) -> DataFrame:
    """Inclusion proofs of all leaves, checked against the manifest's root.

    doc_id, leaf, subroot, root, proof_sha256 (SHA-256 of all siblings, level by level, left to right), folded_root
    (of the tampered leaf if there is one, else the leaf, with the original siblings) and verified (whether that is the
    root). siblings, if kept: for each level an array of those left and an array of those right of the path.

    A leaf partition fetches the minimal union of the nodes that its leaves' proofs lack, derives the interiors that they
    share, and expands every proof by itself. A manifest whose nodes don't agree raises an error.
    """
    root, sources, with_siblings = tree.root, tree.sources, "siblings" in keep
    fetched = missing(tree).join(tree.nodes, ["tree", "level", "pos"]).select("part", "tree", "level", "pos", "digest")

    def prove(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        known: dict[int, dict[tuple[int, int], str]] = {}
        for t, level, k, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "pos", "digest")), strict=True):
            known.setdefault(t, {})[level, k] = digest
        leaves = leaves.sort_by([("src", "ascending"), ("pos", "ascending")])
        src, pos, n = (leaves.column(c).to_numpy() for c in ("src", "pos", "n"))
        row = hexlify(b"".join(leaves.column("leaf").to_pylist()))
        cuts = [0, *(k for k in range(1, len(src)) if src[k] != src[k - 1]), len(src)]
        own = [Levels(row[64 * a : 64 * b], int(pos[a]), int(n[a]), known.get(int(src[a]), {})) for a, b in zip(cuts, cuts[1:], strict=False)]
        top = Levels(b"".join(x.top for x in own), int(src[0]), sources, known.get(TOP, {}))
        if top.top.decode() != root:
            raise ValueError("the nodes of the manifest don't agree with its root")
        out: dict[str, list] = {c: [] for c in ("leaf", "subroot", "proof_sha256", "folded_root", "siblings")}
        tampered = leaves.column("tampered").to_pylist()
        for x, a, b in zip(own, cuts, cuts[1:], strict=False):
            rest, subroot = top.path(int(src[a])), x.top.decode()
            shared = ("", b"", ())  # of a run: what its leaves have in common above it
            for k in range(a, b):
                leaf, path = row[64 * k : 64 * k + 64], x.path(int(pos[k])) + rest
                if shared[0] != (up := int(pos[k]) // ARITY):
                    shared = (up, b"".join(s for pair in path[1:] for s in pair), path[1:])
                out["leaf"].append(leaf.decode())
                out["subroot"].append(subroot)
                out["proof_sha256"].append(hashlib.sha256(b"".join(path[0]) + shared[1] if path else b"").hexdigest())
                out["folded_root"].append(folded(leaf if tampered[k] is None else hexlify(tampered[k]), path).decode())
                if with_siblings:
                    out["siblings"].append([[[s[j : j + 64].decode() for j in range(0, len(s), 64)] for s in pair] for pair in path])
        made = {"doc_id": leaves.column("doc_id"), **{c: pa.array(out[c], pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")}}
        made["verified"] = pa.array([x == root for x in out["folded_root"]], pa.bool_())
        if with_siblings:
            made["siblings"] = pa.array(out["siblings"], pa.list_(pa.list_(pa.list_(pa.string()))))
        return pa.table(made)

    kind = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<array<array<string>>>" * with_siblings
    if root is None:
        return tree.leaves.sparkSession.createDataFrame([], kind).withColumn("root", F.lit(None).cast("string"))
    leaves = tree.leaves.select("part", "doc_id", "leaf", "tampered", "src", "n", "pos")
    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(prove, kind).withColumn("root", F.lit(root))


def tampering() -> Column:
    """Rows whose text the check tampers with: 5 divides the unsigned CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def checked_proofs(docs: DataFrame) -> DataFrame:
    """Proof digests of every row and whether its proof holds after a fifth of the texts were tampered with."""
    out = proofs(build(docs, tampering()), keep=())
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proofs_sql(levels: int = 6) -> str:
    """DuckDB SQL of the rows of checked_proofs over `documents`, for sources and numbers of sources up to 16 ** levels."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(value(c) for c in FIELDS[:-1])} || {value(text)})"
    bits = "flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda k: [CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda s, b: xor(xor(s, b) >> 1, 3988292384::BIGINT * (xor(s, b) & 1))), 4294967295::BIGINT)"
    lines = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN coalesce({crc} % 5 = 0, false) THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM d)",
        "a0 AS (SELECT src AS tree, k, leaf AS h FROM r)",
        "p0 AS (SELECT rid, src AS tree, k, coalesce(other, leaf) AS fold, '' AS sibs FROM r)",
    ]

    def climb(a: str, p: str, to_a: str, to_p: str) -> None:
        lines.append(f"{to_a} AS (SELECT tree, k // {ARITY} AS k, CASE WHEN any_value(alone) THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) = 1 AS alone FROM {a}) GROUP BY tree, k // {ARITY})")
        lines.append(
            f"{to_p} AS (SELECT rid, tree, k // {ARITY} AS k, CASE WHEN alone THEN fold ELSE sha256(string_agg(CASE WHEN ak = k THEN fold ELSE h END, '' ORDER BY ak)) END AS fold, "
            f"sibs || coalesce(string_agg(CASE WHEN ak <> k THEN h END, '' ORDER BY ak), '') AS sibs FROM (SELECT {p}.*, a.k AS ak, a.h, a.alone FROM {p} JOIN (SELECT *, count(*) OVER (PARTITION BY tree) = 1 AS alone FROM {a}) a ON a.tree = {p}.tree AND a.k // {ARITY} = {p}.k // {ARITY}) GROUP BY rid, tree, k, fold, sibs, alone)"
        )

    for i in range(levels):
        climb(f"a{i}", f"p{i}", f"a{i + 1}", f"p{i + 1}")
    lines.append(f"b0 AS (SELECT -1 AS tree, tree AS k, h FROM a{levels})")
    lines.append(f"q0 AS (SELECT rid, -1 AS tree, tree AS k, fold, sibs FROM p{levels})")
    for i in range(levels):
        climb(f"b{i}", f"q{i}", f"b{i + 1}", f"q{i + 1}")
    return f"""
WITH {", ".join(lines)}
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(q.sibs) AS proof_sha256, q.fold AS folded_root, q.fold = t.h AS verified
FROM r JOIN q{levels} q ON q.rid = r.rid JOIN a{levels} s ON s.tree = r.src CROSS JOIN b{levels} t
"""
