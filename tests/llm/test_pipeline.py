"""The pipeline stage by stage against plain versions of its decisions."""

import corpus_pipeline as pipeline
from cases import documents, passages
from test_jaccard import brute

from epochlake.llm import classifiers, common, repeats

SF = "/root/testdata/sf0.01"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark):
    docs = common.read(spark, SF, "documents")
    labels = common.read(spark, SF, "labels")
    scored = {r.doc_id for r in classifiers.quality(docs, labels).where("predicted = 1").collect()}
    after = common.written(pipeline.quality(spark, docs, SF), "t")
    assert after.columns == NAMES and {r.doc_id for r in after.collect()} == scored
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean & scored) >= 0.95 * len(clean)

    rows = [(r.doc_id, r.text) for r in after.collect()]
    wanted = {d for d, _, c in brute(rows, 5, 80, 100) if d == c}
    after = common.written(pipeline.near_copies(spark, after, SF), "t")
    assert {str(r.doc_id) for r in after.collect()} == wanted

    cut = {r.doc_id: r for r in repeats.remove_repeated_words(after).collect()}
    before = {r.doc_id: r for r in after.collect()}
    after = common.written(pipeline.repeated_passages(spark, after, SF), "t")
    for r in after.collect():
        c = cut[r.doc_id]
        assert r.text == (c.kept if c.n_removed else before[r.doc_id].text) and (r.n_chars == len(r.text) if c.n_removed else r.n_chars == before[r.doc_id].n_chars)
    assert after.count() == sum(1 for c in cut.values() if c.kept or not c.n_removed)

    line = lambda t: " ".join(t.lower().split())
    items = [line(r.text) for r in common.read(spark, SF, "benchmark").collect()]
    leaks = {r.doc_id for r in after.collect() if any(t in line(r.text) for t in items)}
    before_leaks = after
    after = common.written(pipeline.benchmark_leaks(spark, after, SF), "t")
    dropped = {r.doc_id for r in before_leaks.collect()} - {r.doc_id for r in after.collect()}
    assert leaks <= dropped  # an item of which a little was cut may be similar enough still
    assert after.columns == NAMES

    last = pipeline.tokens(spark, after, SF).collect()
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in last)
    assert all(len(r.ids) == r.n_tokens for r in last)


def test_odd_rows_go_through(spark):
    docs = documents(spark, passages()).select(NAMES)
    for _, stage in pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "t")
    assert docs.count() > 0
    none = documents(spark, []).select(NAMES)
    for _, stage in pipeline.STAGES:
        none = common.written(stage(spark, none, SF), "t")
    assert none.count() == 0
