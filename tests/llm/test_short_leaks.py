"""Texts with fewer words than a benchmark item, such as copies that are cut off."""

import random

from cases import documents
from test_others import brute_leaks

from epochlake.llm import decontaminate


def brute_short(docs, items):
    """Matches of texts that have fewer words than the item, the whole text as one window."""
    from collections import Counter

    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = set()
    for item, text in items:
        v = text.split()
        for d, t in docs:
            w = t.split()
            if 5 <= len(w) < len(v) and 5 * sum((grams(v) & grams(w)).values()) >= 4 * sum((grams(v) | grams(w)).values()):
                out.add((str(d), item))
    return out


def test_cut_off_copies_are_leaks(spark):
    rng = random.Random(8)
    vocab = [f"b{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([4, 9, 15, 40, 41, 60, 60, 200])] + [(8, "same " * 30)]
    docs = []
    for k, text in items:
        w = text.split()
        for cut in (0, 1, 2, 4, 6, 8, 10, 20, 40):
            docs += [(len(docs) + j, " ".join(x)) for j, x in enumerate((w[cut:], w[: len(w) - cut], w[cut // 2 : len(w) - cut + cut // 2]))]
    for k in range(40):
        w = items[3 + k % 5][1].split()[: -rng.randint(1, 6)]
        w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((len(docs), " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(str(r.doc_id), r.item_id) for r in decontaminate.leaks(documents(spark, docs), bench).collect()}
    short = brute_short(docs, items)
    assert len(short) > 40
    assert got == brute_leaks(docs, items) | short
