"""Merkle manifests against a plain recursive version, with trees of many levels and a hot source."""

import hashlib
import random
import zlib

import compare
import pytest
from cases import documents, odd_texts
from pyspark.sql import functions as F

from epochlake.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, text):
    return h(*(value(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, k):
    out = []
    for nodes in levels[:-1]:
        first = k - k % 16
        out.append((nodes[first:k], nodes[k + 1 : first + 16]))
        k //= 16
    return out


def plain(rows):
    """Rows of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), leaf_of(r, r.text.translate(lower) if changed else r.text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for j, s in enumerate(order):
        for k, (has, i, leaf, other) in enumerate(sorted(by[s])):
            steps = path(trees[s], k) + path(top, j)
            fold = other
            for before, after in steps:
                fold = h(*before, fold, *after)
            out.append((i if has else None, leaf, trees[s][-1][0], root, h(*(x for pair in steps for side in pair for x in side)), fold, fold == root))
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_odd_rows(spark):
    docs = documents(spark, odd_texts() + [(-5, "Minus"), (5, "Upper CASE"), (2**40, "É Ü"), (77, "Very long É " * 200_000)] + [(None, "no id")] * 3)
    clashing = docs.withColumns({c: F.lit("x") for c in ("leaf", "tampered", "at", "range", "place", "src", "part", "pos", "root", "tie")})
    assert found(merkle.checked_proofs(clashing)) == sorted(plain(docs.collect()), key=repr)


@pytest.mark.parametrize("block_levels,partition", [(1, 40), (2, 700), (2, 8192)])
def test_trees_of_many_levels(spark, block_levels, partition):
    """A hot source of four levels, sources of 1, 16, 17 and 256 leaves, and 300 small ones."""
    rng = random.Random(3)
    sizes = [("hot", 4500), (None, 17), ("one", 1), ("run", 16), ("full", 256), ("é", 257), *((f"s{k}", rng.randint(1, 3)) for k in range(300))]
    rows = [(source, f"Text {rng.random()}") for source, n in sizes for _ in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.proofs(merkle.build(docs.repartition(3), merkle.tampering(), block_levels, partition), keep=())
    want = plain(docs.collect())
    assert found(got) == sorted(want, key=repr)
    assert 0 < sum(not x[-1] for x in want) < len(want) / 3


def test_fetches_are_minimal(spark):
    """No node is asked for twice by a partition, nor one that it derives, and siblings prove every leaf."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    tree = merkle.build(docs, None, 1, 64)
    asked = [tuple(r) for r in merkle.missing(tree).collect()]
    assert len(asked) == len(set(asked)) and len({a[0] for a in asked}) > 40
    spans = {(r.part, r.tree): r for r in tree.spans.collect()}
    for part, t, level, pos in asked:
        s = spans[part, t]
        scale = 16 ** (level - s.base)
        assert not s.lo // scale <= pos <= s.hi // scale
        assert pos // 16 in (s.lo // scale // 16, s.hi // scale // 16)
    rows = merkle.proofs(tree).collect()
    assert len(rows) == 3000 and all(r.verified for r in rows)
    for r in rows[::97]:
        fold, n = r.leaf, 0
        for before, after in r.siblings:
            fold, n = h(*before, fold, *after), n + len(before) + len(after)
        assert fold == tree.root and n > 15
        assert h(*(x for pair in r.siblings for side in pair for x in side)) == r.proof_sha256


def test_rows_in_any_order_give_one_root(spark):
    docs = documents(spark, odd_texts())
    roots = {merkle.build(docs.repartition(k)).root for k in (1, 3)}
    assert len(roots) == 1 and merkle.build(docs.where("text = 'tie'")).root == merkle.build(docs.where("text = 'tie'")).subroots.first().subroot
    assert merkle.build(docs.withColumn("lang", F.lit("xx"))).root not in roots


def test_empty_table(spark):
    docs = documents(spark, odd_texts()).where("false")
    assert merkle.build(docs).root is None
    out = merkle.checked_proofs(docs)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_equals_sql(spark):
    assert not compare.compare(queries.op11_merkle(spark, compare.DATA), compare.connect(), queries.ORACLES["op11_merkle"])
