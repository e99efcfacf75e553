"""References of more languages than sixteen."""

from epochlake.llm import divergence


def test_documents_of_every_language_are_judged(spark):
    words = [[f"{c}{d}{e}" for e in "aeiou"] for c in "bcdfghklm" for d in "rw"]
    rows = [(20 * k + j, f"l{k:02d}", " ".join(w[(i + j) % 5] for i in range(60 + k)), None, None) for k, w in enumerate(words) for j in range(3)]
    junk = [(1000 + k, f"l{k:02d}", "%%% §§ ??? " * 20 + " ".join(f"z{k}y{i}" for i in range(60)), None, None) for k in range(len(words))]
    docs = spark.createDataFrame([r[:3] for r in rows + junk], "doc_id long, lang string, text string")
    assert len(divergence.references(docs)) == len(words) == 18
    got = {r.doc_id: r for r in divergence.quality_rules(docs).collect()}
    assert all(got[r[0]].divergence is not None for r in rows + junk)
    assert not any(got[r[0]].kept for r in junk)
