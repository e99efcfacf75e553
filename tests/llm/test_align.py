"""Alignment of two tokenizers against a plain version that encodes every text whole with the libraries."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, odd_texts, passages
from pyspark.sql import functions as F

from epochlake.llm import align, queries

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        with open(A) as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        self.spelled = {i: bytes(other[c] if c in other else ord(c) for c in t) for t, i in vocab.items()}

    def groups(self, text):
        """Groups as lists of (A ids, B ids); none without tokens."""
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x = [self.spelled[i] for i in a]
        y = []
        for i in b:
            p = self.b.id_to_piece(i)
            y.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        raw = (" " + text).encode()
        if b"".join(x) != raw or b"".join(y) != raw:
            return []
        out, i, j, p, q, first, second = [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if p <= q:
                p, first, i = p + len(x[i]), [*first, a[i]], i + 1
            else:
                q, second, j = q + len(y[j]), [*second, b[j]], j + 1
            if p == q:
                out.append((first, second))
                first, second = [], []
        return out

    def rows(self, texts):
        all_groups = [self.groups(t) for t in texts]
        count = Counter((g[0][-1], g[1][-1]) for x in all_groups for g in x)
        best = {}
        for (_, b), n in count.items():
            best[b] = max(best.get(b, 0), n)
        out = []
        for x in all_groups:
            links = [(g[0][-1], g[1][-1]) for g in x]
            said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in x)
            out.append((sum(len(u) for u, _ in x), sum(len(v) for _, v in x), len(x), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if x else ""))
        return out, count, best


@pytest.fixture(scope="module")
def plain():
    return Plain()


def strange_texts():
    rng = random.Random(4)
    alphabet = [*"aaab bc\t\n\r  '1sd\x1c\x85 　éßñ中文😀lltre\x00٣", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "  ", "the ", "aaa", " of", "\n\n", "    "]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    marks = ["▁", "a ▁b", "the of▁", "x ▁ y", "it▁is", " ▁", "▁▁ a"]
    return out + marks + [" ", "  ", "\n", " a", "a ", "a  ", "  a  b  ", "a\n b", "a \nb", "trail \n", "x" * 3000, " " * 3000, "a b " * 3000, "the\n" * 2000, "long text of words " * 20_000]


def test_equals_whole_encoding(spark, plain):
    texts = odd_texts() + list(enumerate(strange_texts(), start=2000)) + passages()[:40]
    clashing = documents(spark, texts).withColumns({c: F.lit("x") for c in ("n_a", "groups", "pair", "N_LINKS")})
    got = align.align(clashing.repartition(3), A, B).collect()
    want, count, best = plain.rows([r.text for r in got])
    assert len(got) == len(texts) and {"lang", "kd", "marks"} <= set(got[0].asDict())
    for r, w in zip(got, want, strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, repr(r.text)
        assert [(g.a, g.b) for g in r.groups] == plain.groups(r.text)
    pairs = {(r.a, r.b): (r.n, r.best) for r in align.pair_counts(documents(spark, texts), A, B).collect()}
    assert pairs == {k: (n, n == best[k[1]]) for k, n in count.items()}
    assert any(n > 1 for n in count.values()) and 0 < sum(w[4] for w in want) < sum(w[3] for w in want)


def test_query_over_documents(spark, plain):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = plain.rows([r.text for r in docs])
    assert {tuple(r) for r in got.collect()} == {(d.doc_id, *w) for d, w in zip(docs, want, strict=True)}


def test_forgets_when_full(spark, plain, monkeypatch):
    for name, value in (("ROWS", 3), ("CHARACTERS", 400), ("LEARNT_CHARACTERS", 60), ("KEPT_CHUNKS", 20)):
        monkeypatch.setattr(align, name, value)
    with open(A, "rb") as a, open(B, "rb") as b:
        files = a.read(), b.read()
    pairs = align.possible_pairs(*align.token_bytes(*files))
    assert len(pairs) < 1_000_000
    texts = strange_texts()[:200]
    want, count, _ = plain.rows(texts)
    counts = np.array([count.get((int(p) >> 32, int(p) & 0xFFFFFFFF), 0) for p in pairs])
    assert counts.sum() == sum(count.values())  # no link outside the possible pairs
    aligner = align.Aligner(*files, pairs)
    aligner.texts(texts[:9])
    aligner.count("corpus", counts)
    for k in range(0, len(texts), 3):
        for x, w in zip(aligner.texts(texts[k : k + 3]), want[k : k + 3], strict=True):
            assert tuple(aligner.numbers[x].sum(axis=0)) == w[:6]
        aligner.rest()


def test_empty_table(spark):
    docs = documents(spark, odd_texts()).where("false")
    assert align.alignment(docs, A, B).count() == 0 and align.pair_counts(docs, A, B).count() == 0
