"""Licences against SQL, and published texts in any layout."""

import random
import textwrap

import pytest
from cases import documents, odd_texts
from compare import compare, connect

from epochlake.llm import common, licenses

SF = "/root/testdata/sf0.01"


def found(spark, texts):
    rows = licenses.licences(documents(spark, texts)).collect()
    return {(r.doc_id, r.licence, r.template): (r.word, r.dice) for r in rows}, rows


def test_licences_equal_sql(spark):
    con = connect(SF)
    assert compare(licenses.licences(common.read(spark, SF, "documents")), con, licenses.licence_sql()) == ""


def test_texts_of_all_kinds_equal_sql(spark):
    """Whole templates with words dropped, put in and changed, inside other words, as the SQL sees them."""
    rng = random.Random(4)
    docs = odd_texts()
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        for trial in range(3):
            w = text.split()
            for _ in range(rng.randint(0, max(1, len(w) // (4 + 4 * trial)))):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["other"], [w[i], "more"]])
            docs.append((10 * k + trial, " ".join([f"a{j}" for j in range(rng.choice([0, 3, 40]))] + w + ["end"] * rng.choice([0, 9]))))
    table = documents(spark, docs)
    con = connect(SF)
    con.execute("DROP VIEW documents")
    con.register("documents", table.toPandas())
    assert compare(licenses.licences(table), con, licenses.licence_sql()) == ""


@pytest.mark.parametrize("width", [10_000, 100, 40])
def test_published_texts_are_found(spark, width):
    """Each text by itself, under a copyright line, in comment marks, and within a longer text."""
    docs, want = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        lines = textwrap.wrap(text, width, break_long_words=False)
        forms = ["\n".join(lines), "Copyright (c) 2020 Somebody\n\n" + "\n".join(lines), "\n".join(f" * {x}" for x in lines), "words before it. " * 30 + "\r\n".join(lines) + " and after" * 50]
        for j, form in enumerate(forms):
            docs.append((10 * k + j, form))
            want.add((10 * k + j, name, k))
    got, _ = found(spark, docs)
    assert want <= set(got) and all(got[x][1] >= 0.98 for x in want)


def test_licence_odd_cases(spark):
    texts = odd_texts() + [(1, "intro\nLICENSED, under the apache license; version 2.0\nend"), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (3, "x " * 50000 + "\nReleased under a MIT License."), (4, "It was released under the MIT license in 2020. See there."), (5, "under license")]
    got, rows = found(spark, texts)
    number = {t: k for k, (_, t) in enumerate(licenses.TEMPLATES)}
    mit, apache = number["Released under the MIT License."], number["Licensed under the Apache License, Version 2.0."]
    assert got[(1, "Apache-2.0", apache)] == (1, 1.0) and got[(2, "MIT", mit)][1] == 1.0
    assert sum(r.doc_id == 2 for r in rows) == 2 and got[(4, "MIT", mit)] == (2, 1.0)
    assert not any(k[0] in (5, None) or k[0] > 900 for k in got)
    assert licenses.licences(documents(spark, [])).count() == 0


def test_telling_words_suffice():
    known = licenses.template_grams()
    words = licenses.telling_words(known, 80, 100)
    for _, grams in known:
        n = len(set(grams))
        assert 2 * 100 * (n - len(licenses.guides(grams, words))) < 80 * (n + n - len(licenses.guides(grams, words)))
