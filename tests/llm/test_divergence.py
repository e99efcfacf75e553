"""Quality rules against a plain version, SQL and labelled rows."""

import math
import random
import re
from collections import Counter

import compare
import pytest
from cases import documents, odd_texts, passages

from epochlake.llm import divergence, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = [re.compile(x) for x in (r"[a-z]", r"[\x20\x09\x0B-\x0D]", r"[A-Z]", r"[0-9٣]", r"\n", r"[.,;:!?'\"()\-]", r"[#*$%&|<>=+_/~^@{}\[\]\\`]")]


def shares(text):
    c = [len(p.findall(text)) for p in CLASSES]
    return [*c, len(text) - sum(c)]


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, kl(p) + kl(q)) / 2)


def plain(rows, rules):
    langs = {}
    for r in rows:
        if r.lang is not None:
            words, chars = langs.setdefault(r.lang, (Counter(), [0] * 8))
            words.update(WORD.findall(r.text or ""))
            for k, x in enumerate(shares(r.text or "")):
                chars[k] += x
    langs = {k: v for k, v in sorted(langs.items(), key=lambda x: (-sum(x[1][0].values()), x[0]))[: rules.languages] if v[0]}
    out = []
    for r in rows:
        text = r.text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        times = Counter(win)
        covered = {j for k, x in enumerate(win) if times[x] > 1 for j in range(k, k + 8)}
        failed = len(w) < rules.least_words or 100 * len(covered) > rules.most_repeated * len(w)
        best = None
        for words, chars in langs.values() if r.lang is None or r.lang in langs else ():
            n, parts = sum(words.values()), []
            if len(text) >= rules.class_characters:
                parts.append(js([x / sum(chars) for x in chars], [x / len(text) for x in shares(text)]) / rules.class_limit)
            if len(w) >= rules.word_limits[0][0]:
                common = [x for x, k in words.items() if k >= n * rules.common]
                own = Counter(w)
                p, q = [words[x] / n for x in common], [own[x] / len(w) for x in common]
                parts.append(js([*p, 1 - sum(p)], [*q, 1 - sum(q)]) / [d for k, d in rules.word_limits if len(w) >= k][-1])
            if parts:
                best = max(parts) if best is None else min(best, max(parts))
        out.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, best and round(round(best, 6), 5), not failed and (best or 0) <= 1))
    return out


def kept_of(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, None if r.divergence is None else round(r.divergence, 5), r.kept) for r in df.collect()]


def strange_texts():
    rng = random.Random(6)
    vocab = ["the", "of", "and", "to", "in"] + [f"word{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choices(vocab, [30, 20, 15, 10, 10] + [1] * 60, k=n))
    out = [prose(n) for n in (19, 20, 39, 40, 99, 100, 150, 400, 3000)]
    out += [prose(60).upper(), " | ".join(prose(150).split()), "\n".join(["a line of words", "another"] * 3 + ["", " ", "x"]), prose(12) + " " + prose(30)]
    same = prose(9)
    return out + [f"{same} {prose(20)} {same}", "a " * 7, "a " * 8, "a " * 9, "#*$% &|<>" * 20, '"quoted" (text) - don\'t' * 12, "\x0b\x0c \x1f x\x85y\xa0z ٣٣ É", "é" * 300, "word " * 40000]


@pytest.mark.parametrize("rules", [divergence.Rules(), divergence.Rules(languages=1, class_characters=1, word_limits=((1, 0.5), (50, 0.4)))])
def test_equals_plain_version(spark, rules):
    docs = documents(spark, odd_texts() + list(enumerate(strange_texts(), start=3000)) + passages()[:40]).cache()
    docs = docs.replace("en", "xx", ["lang"]).where("doc_id % 4 = 1").unionByName(docs.where("coalesce(doc_id, 0) % 4 <> 1"))
    got, want = kept_of(divergence.quality_rules(docs.repartition(3), rules)), plain(docs.collect(), rules)
    assert not set(got) ^ set(want)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x[-1] for x in want} == {True, False} and any(x[-2] is None for x in want) and any(not x[6] and not x[8] for x in want)


def test_nothing_to_compare_with(spark):
    docs = documents(spark, odd_texts()).drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert all(r.divergence is None and r.kept == (not r.base_failed) for r in divergence.quality_rules(docs).collect())
    assert divergence.quality_rules(docs.where("false")).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    divergence.quality_rules(spark.read.parquet(f"{compare.DATA}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_equals_sql_and_labels(spark):
    out = queries.op12_quality_rules(spark, compare.DATA).cache()
    assert not compare.compare(out, compare.connect(), queries.ORACLES["op12_quality_rules"])
    judged = out.where("NOT base_failed").join(spark.read.parquet(f"{compare.DATA}/labels.parquet"), "doc_id")
    by = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.005 * by[1, True] and by[0, False] > 5 * by.get((0, True), 0)
