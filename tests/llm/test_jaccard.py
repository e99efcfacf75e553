"""Near copies against brute force, with large cells and many small ones."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, odd_texts
from pyspark.sql import functions as F

from epochlake.llm import jaccard


def corpus():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(18):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 22, 40, 80, 200, 700]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            docs.append((len(docs), " \n".join(w + [rng.choice(vocab)] * (rng.random() < 0.3))))
    return docs + odd_texts() + [(None, docs[3][1]), (3, docs[3][1])]


def brute(docs, k, p, q):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize(("cell", "sets"), [(400_000, 1000), (300, 1000), (400_000, 4)])
@pytest.mark.parametrize(("k", "p"), [(3, 90), (5, 80)])
def test_components(spark, monkeypatch, cell, sets, k, p):
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", cell)
    monkeypatch.setattr(jaccard, "CELL_SETS", sets)
    docs = corpus()
    random.Random(1).shuffle(docs)
    got = jaccard.near_components(documents(spark, docs).repartition(3), k, p, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(docs, k, p, 100)


def test_empty(spark):
    assert jaccard.near_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("p", [80, 90])
@pytest.mark.parametrize("n", [5, 8, 10, 11, 19, 40, 62, 63, 120, 316, 900, 5000, 20000])
def test_pairs_at_the_threshold_share_a_key(n, p):
    """Every split of the differences between the two sets, so that sizes differ by any amount."""
    rng = np.random.default_rng(n)
    pairs = 0
    for trial in range(60 if n < 5000 else 12):
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        d = int(both.size * (100 - p) / p)
        a = d if trial % 3 == 0 else int(rng.integers(0, d + 1))
        one = np.unique(np.concatenate((both, rng.integers(0, 2**63, a, dtype=np.uint64))))
        two = np.unique(np.concatenate((both, rng.integers(0, 2**63, d - a, dtype=np.uint64))))
        union = len(np.union1d(one, two))
        if 100 * n >= p * union and n < union:
            pairs += 1
            assert len(np.intersect1d(jaccard.keys_of(one, p, 100), jaccard.keys_of(two, p, 100)))
    assert pairs or d == 0


def test_keys_stay_few():
    rng = np.random.default_rng(1)
    for p, most in ((90, 0.4), (80, 1.2)):
        sizes = np.exp(rng.uniform(np.log(20), np.log(8000), 150)).astype(int)
        keys = sum(len(jaccard.keys_of(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), p, 100)) for n in sizes)
        assert keys <= most * sizes.sum()


def test_unrelated_sets_share_no_key():
    """With 4096 places a block, 112 of these sets had an equal block."""
    rng = np.random.default_rng(2)
    keys = np.concatenate([np.unique(jaccard.keys_of(np.unique(x), 80, 100)) for x in rng.integers(0, 2**63, (20_000, 40), dtype=np.uint64)])
    assert len(np.unique(keys)) == len(keys)


@pytest.mark.parametrize("alike", [True, False])
def test_close_pairs_keep_links_and_drop_others(alike):
    rng = np.random.default_rng(4)
    sets, origin = [], []
    for k, n in enumerate([1, 2, 9, 30, 31, 63, 64, 120, 127, 128, 500, 1000, 4000] * 3):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(4):
            both = base[: n - int(rng.integers(0, n // 5 + 1))]
            sets.append(np.unique(np.append(both, rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64))))
            origin.append(k)
    side = rng.integers(0, 2, len(sets))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sizes = np.array([len(x) for x in sets])
    for i, j in jaccard.close_pairs([jaccard.sketch_of(x) for x in sets], sizes, side, 80, 100, alike):
        assert alike or side[i] != side[j]
        assert origin[i] == origin[j] or min(sizes[i], sizes[j]) < 5
        root[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (alike or side[i] != side[j]) and 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                assert find(i) == find(j)


def test_sets_of_a_key_are_cut_by_size_across_batches():
    rows = [(1, 10, 5), (1, 12, 3), (1, 15, 9), (1, 40, 7), (1, 44, 2), (2, 44, 8), (2, 44, 8), (3, 1, 4), (3, 1, 6)]
    parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[a : a + 2], strict=True)], names=["key", "n", "code"]) for a in range(0, len(rows), 2)]
    got = [tuple(x.values()) for b in jaccard.sharing(iter(parts), 80, 100) for x in b.to_pylist()]
    assert sorted(got) == [(2, 7), (3, 5), (6, 4), (9, 5)]


def test_other_texts_are_kept_out_of_the_shuffle(spark):
    docs = spark.range(20_000).select((F.col("id") - 5000).alias("kd"), F.xxhash64("id").alias("tie"), F.lit("x").alias("text"))
    members = docs.where("kd % 20 = 0").select("kd", "tie")
    got = jaccard.likely(docs, members)
    assert got.columns == docs.columns
    assert members.exceptAll(got.select("kd", "tie")).isEmpty()
    assert got.count() <= 3000
    assert jaccard.likely(docs, members.limit(0)).isEmpty()
