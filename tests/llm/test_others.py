"""BPE, classifiers, licences, leaks, pages and vectors against libraries, plain versions and held-out labels."""

import hashlib
import html as references
import random
import re

import numpy as np
import pytest
from cases import documents, odd_texts, passages
from pyspark.sql import functions as F

from epochlake.llm import bpe, common, decontaminate, hnsw, html, queries

SF = "/root/testdata/sf0.01"


# --- BPE ---


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = [*"aaaab bc\t\n\r  '1sd\x1c\x85 　éßñ中文😀lltre\x00٣", "<|endoftext|>", "  ", "the ", "aaa"]
    texts = odd_texts() + [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))) for k in range(500)] + [(999, "the and of " * 20000)]
    got = bpe.encode(documents(spark, texts).repartition(2), path).collect()
    assert len(got) == len(texts) and {"lang", "kd"} <= set(got[0].asDict())
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert list(r.ids) == ids and r.decoded == back and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_forgets_when_full(monkeypatch):
    path = queries.tokenizer_path()
    monkeypatch.setattr(bpe, "KEPT_PARTS", 20)
    monkeypatch.setattr(bpe, "MERGED_WORDS", 7)
    codec = bpe.Codec(bpe.load_vocabulary(path))
    texts = [" ".join(f"word{k * j % 31}x" for j in range(30)) for k in range(12)]
    assert [codec.decode(x) for x in codec.encode(texts)] == texts


# --- leaks ---


def brute_leaks(docs, items, p=80, q=100):
    from collections import Counter

    words = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = set()
    for item, text in items:
        v = words(text)
        if item is None or not v:
            continue
        g = grams(v)
        for d, t in docs:
            w = words(t)
            if any(q * sum((g & h).values()) >= p * sum((g | h).values()) for i in range(len(w) - len(v) + 1) for h in [grams(w[i : i + len(v)])]):
                out.add((str(d), item))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"b{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 6, 15, 30, 60])))) for k in range(12)] + [(50, None), (51, ""), (None, "x y z")]
    docs = odd_texts()
    for k in range(60):
        w = items[k % 12][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((k, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 40))] + [x.upper() + "," for x in w] + [rng.choice(vocab) for _ in range(rng.randint(0, 40))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(str(r.doc_id), r.item_id) for r in decontaminate.leaks(documents(spark, docs), bench).collect()}
    assert got == brute_leaks(docs, items)
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.leaks(documents(spark, docs), bench.limit(0)).count() == 0


def test_leaks_in_parts(spark, monkeypatch):
    docs, bench = common.read(spark, SF, "documents"), common.read(spark, SF, "benchmark")
    whole = sorted(decontaminate.leaks(docs, bench).collect())
    for bound, most in (("PART_CHARS", 3000), ("PART_ITEMS", 9)):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, bound, most)
            assert sorted(decontaminate.leaks(docs, bench).collect()) == whole


def test_hamming_index_finds_all():
    rng = np.random.default_rng(4)
    words = decontaminate.BITS // 64
    prints = rng.integers(0, 2**63, (300, words), dtype=np.uint64)
    asked = prints[:80].copy()
    for k in range(80):
        for b in rng.choice(decontaminate.BITS, 2 + k % 70, replace=False).tolist():
            asked[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    far = lambda a, b: sum(int(x).bit_count() for x in a ^ b)
    want = {(i, j) for i in range(80) for j in range(300) if far(asked[i], prints[j]) <= decontaminate.RADIUS}
    assert len(want) >= 75
    assert {tuple(x) for x in decontaminate.HammingIndex(prints).within(asked).tolist()} == want


@pytest.mark.parametrize("n", [9, 18, 45, 180])
def test_fingerprints_at_the_threshold_are_within_the_radius(n):
    """Thousands of pairs of windows of n shingles whose similarity is just 0.8."""
    rng = np.random.default_rng(n)
    missed = 0
    for _ in range(3000):
        both = rng.integers(0, 2**63, n - n // 9, dtype=np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 2**63, n // 9, dtype=np.uint64))) for _ in range(2))
        assert abs(decontaminate.weighted_similarity(a, b) - 0.8) < 1e-9
        x, y = (decontaminate.fingerprints(decontaminate.bit_signs(s).sum(axis=0, keepdims=True)) for s in (a, b))
        missed += int(np.bitwise_count(x ^ y).sum()) > decontaminate.RADIUS
    assert missed <= 1


# --- pages ---


def test_articles_of_the_pages(spark):
    pages = common.read(spark, SF, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1].replace("<b>", "")
        blocks = [" ".join(references.unescape(b).split()) for b in re.split(r"</?(?:h1|p|br)>", inner)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_page_odd_cases(spark):
    rows = [(1, "http://a.org/1", None), (2, None, ""), (3, "http://a.org/2", "<p>a &lt;b&gt; &amp;amp; &eacute;&#x41;<p>c<script>x='</p>'</script><!-- no --><div class='side-bar sidebar'>no</div>d"), (None, "x", "<div>open <b>bold <p>par"), (4, "http://b.org", "</div></p>stray<article><p>in</p><aside>no</aside><form>no</form><section id=comments>no</section></article><p>out")]
    rows += [(10 + k, f"https://t.org/{k}", f"<div>Join our club today</div><p>own {k}</p><ul><li>same</li></ul>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("marks", F.lit(1))
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[1] == "" and got[2] == "" and got[None] == "open bold par"
    assert got[3] == "a <b> &amp; éA c d" and got[4] == "in"
    assert all(got[10 + k] == f"own {k}" for k in range(12))
    assert html.extract(pages.limit(0)).count() == 0


# --- vectors ---


def brute_links(rows, least=0.95):
    ok = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least
    links = {id(r): [s for s in ok if s is not r and near(r[1], s[1])] for r in ok}
    out = []
    for r in rows:
        seen, todo = {id(r): r}, [r]
        while todo:
            for s in links.get(id(todo.pop()), []):
                if id(s) not in seen:
                    seen[id(s)] = s
                    todo.append(s)
        ids = [s[0] for s in seen.values() if s[0] is not None]
        out.append((str(r[0]), len(links.get(id(r), [])), str(min(ids) if ids else None)))
    return sorted(out)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        base = rng.standard_normal(8)
        rows += [(len(rows) + j, [float(np.float32(v)) for v in base + rng.standard_normal(8) * 0.12]) for j in range(int(rng.choice([1, 2, 6])))]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, list(rows[0][1])), (907, [1.0, 2.0]), (908, [1.0, 2.0]), (None, list(rows[3][1]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("x"))
    got = hnsw.vector_links(df.repartition(3), shards=3).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert hnsw.vector_links(df.limit(0)).count() == 0


def clusters(n, size, dim, seed):
    """Clusters of vectors, most of whose pairs link and some of which lie about the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    spread_ = rng.uniform(0.05, 0.25, n)
    x = np.repeat(base, size, axis=0) + np.repeat(spread_, size)[:, None] * rng.standard_normal((n * size, dim))
    return x.astype(np.float32)


def test_vector_recall(spark):
    """Tens of thousands of links among 12,000 vectors of three large shards: nearly all are found, none is made up."""
    x = clusters(1200, 10, 48, 11)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: r.n_links for r in hnsw.vector_links(df, shards=3).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = np.concatenate([((u[k : k + 2000] @ u.T) >= 0.95).sum(axis=1) for k in range(0, len(u), 2000)]) - 1
    assert links.sum() > 30_000
    assert sum(got.values()) >= 0.99 * links.sum() and all(got[k] <= n for k, n in enumerate(links.tolist()))


def test_shards_follow_memory():
    assert hnsw.shards_of(1000, 64_000) == hnsw.SHARDS
    assert hnsw.shards_of(10**6, 64 * 10**6) == 17
    for dim in (64, 768, 1536):  # vectors of a shard, in bytes
        assert 10**6 * dim * 4 / hnsw.shards_of(10**6, 10**6 * dim) <= hnsw.SHARD_BYTES


def test_slices_by_vectors_and_bytes():
    for number in (1000, 10**5, 10**6):
        for dim in (64, 768, 1536):
            slices = hnsw.slices_of(number, number * dim)
            assert number / slices <= hnsw.SLICE_VECTORS and 4 * number * dim / slices <= hnsw.SLICE_BYTES


def test_wide_searches_go_in_parts(monkeypatch):
    """All queries whose beam was full were asked again together, in beams up to the size of the shard."""
    rng = np.random.default_rng(8)
    x = hnsw.unit((np.eye(1, 16) + 0.02 * rng.standard_normal((1500, 16))).astype(np.float32)).astype(np.float32)
    graph, places, nearest = hnsw.Graph(x, np.arange(len(x))), [], hnsw.Layer.nearest
    monkeypatch.setattr(hnsw, "BEAM_PLACES", 20_000)
    monkeypatch.setattr(hnsw.Layer, "nearest", lambda self, q, entry, beam, expand=4: places.append(len(q) * beam) or nearest(self, q, entry, beam, expand))
    rows, found = graph.search(x[:64], 48, 0.95)
    assert max(places) <= 20_000
    assert len(rows) == (x[:64] @ x.T >= 0.95).sum()


def test_graphs_are_not_shuffled(spark, monkeypatch):
    """A graph went through a shuffle once for each slice: most bytes of the vectors' tasks."""
    monkeypatch.setattr(hnsw, "SLICES", 40)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rng.standard_normal((600, 8)))], "vec_id long, embedding array<float>")
    kinds = []
    save = hnsw.written
    monkeypatch.setattr(hnsw, "written", lambda frame, what: kinds.append((what, frame._jdf.queryExecution().optimizedPlan().toString())) or save(frame, what))
    assert hnsw.vector_links(df, shards=3).count() == 600
    assert [what for what, _ in kinds] == ["vector-classes", "vector-links"]
    assert not any("graph" in plan for _, plan in kinds)



# --- linked groups ---


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(500, 500), (None, 3), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in root}
