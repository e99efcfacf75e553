"""Classifiers against plain versions that are written from their definitions, and held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, odd_texts, passages
from pyspark.sql import functions as F

from epochlake.llm import classifiers, common
from epochlake.llm.text import as_bytes

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("fit", "label", "limit"), [(classifiers.toxicity, "toxic", 0.95), (classifiers.quality, "quality", 0.9)])
def test_held_out_accuracy(spark, fit, label, limit):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    rows = fit(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= limit


@pytest.mark.parametrize("fit", [classifiers.toxicity, classifiers.quality])
def test_classifier_odd_cases(spark, fit):
    docs = documents(spark, passages())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit(docs, none).count() == docs.count()
    some = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = fit(docs, some).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert fit(documents(spark, []), some).count() == 0


def test_labels_of_the_fold_are_not_read(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(classifiers.fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifiers.quality(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_toxic_documents_are_found(spark):
    """Recall and false alarms of the held-out fold, for accuracy hides missed toxic documents."""
    docs, labels = (common.read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = classifiers.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.03


@pytest.mark.parametrize("fit", [classifiers.toxicity, classifiers.quality])
def test_labels_of_one_kind(spark, fit):
    docs = documents(spark, passages())
    score = {}
    for y in (0, 1):
        some = spark.createDataFrame([(k, y, y) for k in range(40)], "doc_id long, quality int, toxic int")
        score[y] = {r.score for r in fit(docs, some).collect()}
        assert len(score[y]) == 1
    assert max(score[0]) < 0.1 and min(score[1]) > 0.9
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in fit(docs, none).collect()} == {0.0}


def test_the_sample_is_bounded(spark):
    texts = [(k, f"text {k} " * 50) for k in range(60)] + [(k, f"text {k} " * 50) for k in range(20)] + [(7, "z" * 5000)]
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, toxic int")
    take = lambda **kw: [r.text for r in classifiers.labelled_sample(documents(spark, texts), labels, "toxic", lambda c: c >= 0, **kw).collect()]
    assert len(take()) == 61 and len(take(max_rows=10)) == 10
    small = take(max_bytes=8000)
    assert 10 < len(small) and sum(map(len, small)) <= 8000 and "z" * 5000 not in small


# --- plain versions ---


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sample_of(docs, labels, label, learn):
    y = {}
    for r in labels:
        if r[label] in (0, 1) and learn(r.doc_id):
            y[r.doc_id] = max(y.get(r.doc_id, 0), r[label])
    return [(text, y[d]) for d, text in docs if d in y]


def plain_grams(text):
    s = " " + " ".join((text or "").lower().split()) + " "
    return {s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)}


def bucket(gram):
    """The bucket of one n-gram: what the hashing gives for it alone, padding taken off."""
    n, mask = len(gram), (1 << 64) - 1
    total = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(gram)) & mask
    for _ in range(2):
        total = (total ^ (total >> 32)) * 0xD6E8FEB86659FD93 & mask
    return ((total ^ (total >> 32)) ^ n) >> 42


def test_toxicity_equals_plain_regression(spark):
    docs = [(r.doc_id, r.text) for r in common.read(spark, "/root/testdata/sf0.001", "documents").collect()]
    labels = common.read(spark, "/root/testdata/sf0.001", "labels")
    train = sample_of(docs, labels.collect(), "toxic", lambda d: crc(d) % 5 != 0)
    pos, neg = sum(y for _, y in train), sum(1 - y for _, y in train)
    held = [({bucket(g) for g in plain_grams(t)}, y) for t, y in train]
    counts = [Counter(b for bs, y in held for b in bs if y == k) for k in (0, 1)]

    def g_of(b):
        y0, y1, n = counts[0][b], counts[1][b], pos + neg
        part = lambda seen, rows, both: seen * math.log(seen * n / (both * rows)) if seen else 0.0
        return 2 * (part(y1, pos, y1 + y0) + part(y0, neg, y1 + y0) + part(pos - y1, pos, n - y1 - y0) + part(neg - y0, neg, n - y1 - y0))

    apart = sorted(((-g_of(b), b) for b in set(counts[0]) | set(counts[1])))
    apart = [x for x in apart if -x[0] > 6.6]
    features = sorted(b for _, b in apart[: max(500, sum(-g > 20 for g, _ in apart))])
    r = {b: math.log((counts[1][b] + 1) / (pos + 2)) - math.log((counts[0][b] + 1) / (neg + 2)) for b in features}
    w, m, v, bias = dict.fromkeys(features, 0.0), Counter(), Counter(), math.log((pos + 1) / (neg + 1))
    rows = [([b for b in features if b in bs], y) for bs, y in held]
    sig = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))
    for t in range(1, 151):
        grad, gb = {b: 1e-3 * w[b] for b in features}, 0.0
        for bs, y in rows:
            d = (0.5 * len(rows) / (pos if y else neg)) * (sig(sum(w[b] * r[b] for b in bs) + bias) - y) / len(rows)
            gb += d
            for b in bs:
                grad[b] += d * r[b]
        for b, g in [*grad.items(), (None, gb)]:
            m[b], v[b] = 0.9 * m[b] + 0.1 * g, 0.999 * v[b] + 0.001 * g * g
            step = 0.05 * (m[b] / (1 - 0.9**t)) / (math.sqrt(v[b] / (1 - 0.999**t)) + 1e-8)
            if b is None:
                bias -= step
            else:
                w[b] -= step
    known = set(features)
    want = {d: sig(sum(w[b] * r[b] for b in {bucket(g) for g in plain_grams(t)} & known) + bias) for d, t in docs}
    got = {x.doc_id: x.score for x in classifiers.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    assert features and set(got) == set(want) and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_quality_equals_plain_ftrl(spark):
    docs = [(r.doc_id, r.text) for r in common.read(spark, "/root/testdata/sf0.001", "documents").collect()]
    labels = common.read(spark, "/root/testdata/sf0.001", "labels")
    train = sample_of(docs, labels.collect(), "quality", lambda d: crc(d) % 4 != 2)

    def features(text):
        raw = as_bytes((text or "").encode())
        a, b = classifiers.token_bounds(raw)
        words = [raw[x:y].tobytes() for x, y in zip(a, b, strict=True)]
        plain = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", raw.tobytes())
        assert words == plain
        idx, val = classifiers.word_features(raw)
        return list(zip(idx.tolist(), val.tolist(), strict=True))

    made = sorted((y, np.array([i for i, _ in f], np.int32).tobytes(), np.array([x for _, x in f], np.float32).tobytes(), f) for f, y in ((features(t), y) for t, y in train))
    rows = [(f, y) for y, _, _, f in made]
    z, n, bias = Counter(), Counter(), 1 << 18
    sig = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

    def weight(i):
        l1 = 0.0 if i == bias else 0.3
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.1)

    order = np.random.default_rng(7)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            f, y = [*rows[k][0], (bias, 1.0)], rows[k][1]
            w = {i: weight(i) for i, _ in f}
            p = sig(sum(w[i] * x for i, x in f))
            for i, x in f:
                g = (p - y) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                n[i] += g * g
    want = {d: sig(sum(weight(i) * x for i, x in [*features(t), (bias, 1.0)])) for d, t in docs}
    got = {x.doc_id: x.score for x in classifiers.quality(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_null_and_empty_texts_score_alike(spark):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    for fit in (classifiers.toxicity, classifiers.quality):
        rows = {r.doc_id: r.score for r in fit(documents(spark, passages() + odd_texts()[:3]), labels).collect()}
        assert rows[901] == rows[902] and all(0 <= s <= 1 for s in rows.values())
