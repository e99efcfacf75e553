"""Repeated words and bytes against brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, passages
from pyspark.sql import functions as F

from epochlake.llm import repeats

LOW = -(2**63)


def brute_words(docs, size=35):
    texts = {(LOW if d is None else d, t or ""): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen = {}
    for k, w in texts.items():
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), set()).add((k, i))
    out = []
    for d, t in docs:
        w = texts[(LOW if d is None else d, t or "")]
        gone = set()
        for i in range(len(w) - size + 1):
            if len(seen[tuple(w[i : i + size])]) > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(docs, tie, size=100):
    key = lambda d, t: (LOW if d is None else d, tie.get(t or "", 0))
    texts = {key(d, t): (t or "").encode() for d, t in docs}
    first = {}
    for k, b in texts.items():
        for i in range(len(b) - size + 1):
            x = b[i : i + size]
            first[x] = min(first.get(x, (k, i)), (k, i))
    out = []
    for d, t in docs:
        k, b = key(d, t), texts[key(d, t)]
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (k, i):
                gone[i : i + size] = [True] * size
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("first_stays", [True, False])
def test_decisions_on_parts_equal_those_on_the_whole(first_stays):
    """Marks don't depend on how rows arrive; what is cut off goes on to longer anchors, first copies included."""
    rng = np.random.default_rng(5)
    keys = sorted((int(rng.integers(4)), 0, int(rng.integers(5)), int(rng.integers(6)), 0, int(rng.integers(3))) for _ in range(300))
    names = [c.split()[0] for c in repeats.SEGMENT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    columns = [pa.array(x, k) for x, k in zip(zip(*keys, strict=True), kinds, strict=True)] + [pa.array([3] * 300, pa.int32()), pa.array([False] * 300)]
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    marks = []
    for rows, size in ((1000, 300), (2, 1), (7, 5), (40, 13)):
        parts = [batch.slice(k, size) for k in range(0, 300, size)]
        got = [r for b in repeats.Decisions(35, first_stays, 10**9, False, rows)(iter(parts)) for r in b.to_pylist()]
        gone = {(r["h"], r["kd"], r["start"]) for r in got if r["what"] == repeats.GONE}
        seen = gone | {(r["h"], r["kd"], r["start"]) for r in got if r["what"] != repeats.GONE}
        marks.append(gone)
        assert first_stays and gone == marks[0] or gone <= marks[0] and marks[0] <= seen


def long_runs():
    """Equal units in a row, short periods, and one anchor in very many contexts."""
    rng = random.Random(11)
    docs = [(1000, "z" * 9000), (1001, "x" + "z" * 5000 + "y"), (1002, "ab" * 3000), (1003, "q " * 4000), (1004, "a b c " * 900), (1005, "q " * 100)]
    core = " ".join(f"core{k}" for k in range(12))
    docs += [(2000 + k, " ".join(f"l{rng.randrange(50)}" for _ in range(40)) + f" {core} " + " ".join(f"r{rng.randrange(50)}" for _ in range(40))) for k in range(60)]
    return docs + [(3000 + k, docs[10 + k][1][60:]) for k in range(20)]


@pytest.mark.parametrize(("most", "bits", "rows"), [(repeats.GROUP_UNITS, 27, 50_000), (300, 16, 7), (60, 16, 50_000), (300, 16, 2)])
def test_words(spark, monkeypatch, most, bits, rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", rows)
    docs = passages() + long_runs()
    got = repeats.remove_repeated_words(documents(spark, docs).repartition(3), most_bits=bits, most=most)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_words(docs)


@pytest.mark.parametrize(("most", "rows"), [(repeats.GROUP_UNITS, 50_000), (900, 7), (120, 50_000), (900, 2)])
def test_bytes(spark, monkeypatch, most, rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", rows)
    docs = passages() + long_runs()
    tie = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64("t")).collect()}
    got = repeats.remove_later_bytes(documents(spark, docs).repartition(3), most=most)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_bytes(docs, tie)


def test_longest_previous_factors():
    rng = random.Random(1)
    texts = [b"", b"a", b"a" * 60, b"ab" * 40, b"abcabx" * 12] + [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 150))) for _ in range(30)]
    for text in texts:
        for width in (7, 40):
            n = len(text)
            suffixes = np.array([list(text[i : i + width].ljust(width, bytes([1]))) for i in range(n)], dtype=np.uint8).reshape(n, width)
            rank = np.array(rng.sample(range(n), n), dtype=np.int64) if rng.random() < 0.5 else np.arange(n)
            same = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
            want = [max((same(suffixes[i], suffixes[j]) for j in range(n) if rank[j] < rank[i]), default=0) for i in range(n)]
            assert repeats.longest_previous_factors(suffixes, rank).tolist() == want


def test_one_anchor_of_many_segments():
    """As many segments as one task compares at once, all of their windows repeated: memory stays bounded."""
    code = """
import numpy as np, resource
from epochlake.llm import repeats
rng = np.random.default_rng(3)
core = b"one anchor of twenty"
n = repeats.GROUP_UNITS // 180
half = [rng.integers(97, 123, 80, dtype=np.uint8).tobytes() + core + rng.integers(97, 123, 80, dtype=np.uint8).tobytes() for _ in range(n // 2)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
position = np.arange(2 * len(half)), np.zeros(2 * len(half), dtype=np.int64), np.zeros(2 * len(half), dtype=np.int64)
owner, place = repeats.earlier_factors(half * 2, np.zeros(2 * len(half), dtype=np.int64), position)
assert np.array_equal(np.unique(owner), np.arange(len(half), 2 * len(half))) and len(owner) == 81 * len(half)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(out.stdout) < 400


def test_equal_bytes_make_few_segments():
    for kind, raw in ((repeats.BYTES, b"0" * 1_000_000), (repeats.WORDS, b"0 " * 500_000)):
        assert len(repeats.segments_of(kind.values(np.frombuffer(raw, dtype=np.uint8)), kind, 0)[0]) < 600


@pytest.mark.parametrize("most_bits", [16, 27])
def test_estimates_are_never_below_the_counts(spark, most_bits):
    docs = passages() + long_runs()
    base = repeats.keyed(documents(spark, docs))
    found = repeats.segments(base, repeats.WORDS)
    maps = repeats.count_sketch(found, most_bits=most_bits).value
    texts = {d.text for d in base.select("text").collect() if d.text}
    counts = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - 34):
            counts[tuple(w[i : i + 35])] = counts.get(tuple(w[i : i + 35]), 0) + 1
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        h, _, first, n, _ = repeats.segments_of(repeats.WORDS.values(np.frombuffer(t.encode(), dtype=np.uint8)), repeats.WORDS, 0)
        twice = repeats.estimated_twice(maps, h.view(np.uint64))
        for ok, a, k in zip(twice, first.tolist(), n.tolist(), strict=True):
            assert ok or all(counts.get(tuple(w[i : i + 35]), 1) == 1 for i in range(a, a + k))


def test_empty_and_kept_columns(spark):
    none = documents(spark, [])
    assert repeats.remove_repeated_words(none).count() == 0
    assert repeats.remove_later_bytes(none).count() == 0
    cut = repeats.remove_repeated_words(documents(spark, passages()), keep=True)
    assert {"lang", "source", "n_chars", "score", "kept"} <= set(cut.columns)
    assert cut.count() == len(passages())
