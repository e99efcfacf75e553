"""Quality rules: repeats, symbols and length, and how far a document's distributions are from those of a language.

DataFrame functions only. Histograms of character classes and of common words are compared with those of language
references, which are counted over all documents, by Jensen-Shannon distance (base 2, from 0 to 1).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, the symbols that are counted, words of a window.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"#*$%&|<>"
WINDOW = 8
#: Classes of characters in regular expressions that Spark and SQL read alike; a last class holds the rest.
SPACE_CLASSES = (r"\n", r"\x20\x09\x0B-\x0D")
CLASSES = ("a-z", SPACE_CLASSES[1], "A-Z", r"\p{N}", SPACE_CLASSES[0], r".,;:!?'\x22()\-", r"#*$%&|<>=+_/~^@{}\[\]\\`")


@dataclass(frozen=True)
class Rules:
    """least_words and most_repeated (percent) are the base rules. A word is common that makes up at least `common` of its
    language's words; references are those of all languages, or only of the `languages` with the most words. A document's
    classes are compared from `class_characters` on, its words by the limits of (words, distance), the longest length that it reaches."""

    least_words: int = 20
    most_repeated: int = 30
    common: float = 1 / 500
    languages: int | None = None
    class_characters: int = 200
    class_limit: float = 0.3
    word_limits: tuple[tuple[int, float], ...] = ((40, 0.45), (100, 0.37))


def words_of(text: Column) -> Column:
    """Words in order; none of a text that is null or has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def with_classes(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Rows with the number of characters of each class of a text, the rest last.

    Characters of the classes are taken out one class after the other, the most usual first, so that all steps but the
    first go over what little is left.
    """
    last, sizes = text, []
    for k, c in enumerate(CLASSES):
        rows = rows.withColumn(f"left_{k}", F.regexp_replace(last, f"[{c}]+", ""))
        sizes.append(F.length(last) - F.length(f"left_{k}"))
        last = f"left_{k}"
    rows = rows.withColumn(name, F.array(*sizes, F.length(last)).cast("array<long>"))
    return rows.drop(*(f"left_{k}" for k in range(len(CLASSES))))


def references(docs: DataFrame, rules: Rules = Rules()) -> list[dict]:
    """For each language (a value of lang that isn't null) the shares of its classes and of its common words, by language.

    Counts cover all words of all documents and are summed before they are shuffled. The driver gets a row for each
    language, and in each at most 1 / `common` words.
    """
    docs = docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).where("lang IS NOT NULL")
    counts = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # the counts are shuffled once for both sides
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if rules.languages is not None:
        totals = totals.orderBy(F.desc("total"), "lang").limit(rules.languages)
    common = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * rules.common)
    each = totals.select("lang", "total", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n"))
    words: dict[str, dict[str, float]] = {}
    for r in common.select("lang", "total", "word", "n").unionByName(each).collect():
        words.setdefault(r["lang"], {})
        if r["word"] is not None:
            words[r["lang"]][r["word"]] = r["n"] / r["total"]
    if not words:
        return []
    sums = with_classes(docs.where(F.col("lang").isin(*words)), "text", "c").groupBy("lang").agg(*(F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)))
    out = []
    for r in sums.orderBy("lang").collect():
        out.append({"lang": r["lang"], "classes": [n / sum(r[1:]) for n in r[1:]], "words": dict(sorted(words[r["lang"]].items()))})
    return out


def term(p: Column, q: Column) -> Column:
    """What a bin of shares p and q adds to twice the divergence."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return part(p) + part(q)


def base(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, w) with n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and classes.

    Windows of a text are compared by 64-bit hashes within their row; those of eight words are hashes of two of four, and
    only texts in which four words stand twice have any made. Exploding an array of one value computes it once, where
    later steps would repeat the expression.
    """
    once = lambda c: F.explode(F.array(c))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    rows = with_classes(rows, "text", "classes").select("doc_id", "classes", F.length("text").alias("n_chars"), once(words_of(F.col("text"))).alias("w"),
        F.length(F.regexp_replace(F.regexp_replace("text", "[a-z]+", ""), f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"), once(lines).alias("lines"))
    kept = ["doc_id", "classes", "n_chars", "w", "n_symbols"]
    rows = rows.select(*kept, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), once(F.expr("transform(w, x -> xxhash64(x))")).alias("h"))
    kept = [*kept, "n_dup_lines"]
    for step in (1, 2):
        rows = rows.select(*kept, once(joined_hashes("h", step)).alias("h"))
    rows = rows.select(*kept, once(F.expr("if(size(h) = size(array_distinct(h)), array(), h)")).alias("h"))
    rows = rows.select(*kept, once(joined_hashes("h", 4)).alias("h"))
    rows = rows.select(*kept, once(F.expr("""
        if(size(h) = size(array_distinct(h)), array(), sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))))""")).alias("s"))  # fmt: skip
    places = F.expr("sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h)), x -> x.i))")
    rows = rows.select(*kept, once(places).alias("at"))
    covered = F.expr(f"""if(size(at) = 0, 0, {WINDOW} + aggregate(
        zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (a, b) -> least({WINDOW}, b - a)), 0, (a, x) -> a + x))""")  # fmt: skip
    spaces = sum((F.col("classes")[k] for k, c in enumerate(CLASSES) if c in SPACE_CLASSES), F.lit(0))
    return rows.select(*kept, F.size("w").cast("long").alias("n_words"), (F.col("n_chars") - spaces).cast("long").alias("word_chars"), covered.cast("long").alias("n_repeat_words"))


def joined_hashes(h: str, step: int) -> Column:
    """Hashes of runs twice as long, from those of two runs next to each other."""
    return F.expr(f"if(size({h}) > {step}, zip_with(slice({h}, 1, size({h}) - {step}), slice({h}, {step + 1}, size({h}) - {step}), (a, b) -> xxhash64(a, b)), array())")


def quality_rules(docs: DataFrame, rules: Rules = Rules(), known: list[dict] | None = None) -> DataFrame:
    """Base counts of every document, and whether the base rules and the divergence from the languages let it stay.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    one), n_repeat_words (words in windows of eight that stand twice or more), base_failed, divergence and kept.
    divergence is that from the nearest reference: the larger of both distances, each over its limit; above 1 the
    document is rejected. Classes of texts under 200 characters and words of those under 40 aren't judged, for short
    texts are far from any distribution by chance, and limits are wider below 100 words; divergence is null where
    neither is judged, where there is no reference, and of a document whose own language has none. Null texts count
    as empty; null ids and rows that repeat are judged each; texts count whole; a null lang is compared like any other.

    Nothing but the references' counts is shuffled. References, which are known or counted over docs, are literals.
    """
    known = references(docs, rules) if known is None else known
    langs = docs.select("doc_id", "text", F.col("lang").alias("own"))
    own = F.col("own").isNull() | F.col("own").isin(*[r["lang"] for r in known]) if known else F.lit(False)
    out = base(langs.select(F.struct("doc_id", own.alias("own")).alias("doc_id"), "text"))
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.own").alias("own"), *columns[1:], "n_chars", "classes", "w", failed.alias("base_failed"))
    if not known:
        return out.select(*columns, "base_failed", F.lit(None).cast("double").alias("divergence"), (~F.col("base_failed")).alias("kept"))

    kind = "array<struct<lang: string, classes: array<double>, words: map<string, double>>>"
    refs = F.from_json(F.lit(json.dumps(known)), kind)
    by_class = F.col("own") & (F.col("n_chars") >= rules.class_characters)
    by_word = F.col("own") & (F.col("n_words") >= rules.word_limits[0][0])
    vocabulary = sorted({w for r in known for w in r["words"]})
    once = lambda c: F.explode(F.array(c))
    none = F.array().cast("array<string>")
    sorted_words = F.when(by_word, F.sort_array(F.filter("w", lambda x: x.isin(*vocabulary)))).otherwise(none) if vocabulary else none
    out = out.select(*columns, "base_failed", by_class.alias("by_class"), by_word.alias("by_word"), F.col("classes").alias("c"), once(sorted_words).alias("w"))
    starts = F.expr("if(size(w) = 0, array(), filter(sequence(0, size(w) - 1), i -> i = 0 OR w[i] <> w[i - 1]))")
    out = out.select(*columns, "base_failed", "by_class", "by_word", "c", "w", once(starts).alias("at"))
    held = F.expr("transform(at, (p, k) -> struct(w[p] AS word, (if(k + 1 < size(at), at[k + 1], size(w)) - p) / n_words AS q))")
    out = out.select(*columns, "base_failed", "by_class", "by_word", "c", once(held).alias("held"))

    limit = F.lit(rules.word_limits[0][1])
    for n, distance in rules.word_limits[1:]:
        limit = F.when(F.col("n_words") >= n, F.lit(distance)).otherwise(limit)
    distance = lambda twice: F.sqrt(F.greatest(twice, F.lit(0.0)) / 2)
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)

    def class_part(r: Column) -> Column:
        twice = F.aggregate(F.zip_with(r["classes"], F.col("c"), lambda p, n: term(p, n / total)), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col("by_class"), distance(twice) / rules.class_limit)

    def word_part(r: Column) -> Column:
        hits = F.filter(F.transform("held", lambda e: F.struct(F.element_at(r["words"], e["word"]).alias("p"), e["q"].alias("q"))), lambda e: e["p"].isNotNull())
        start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("twice"))
        # sums over the words that the document has; of the others each adds its share, of both the rest is one more bin
        add = lambda a, e: F.struct((a["p"] + e["p"]).alias("p"), (a["q"] + e["q"]).alias("q"), (a["twice"] + term(e["p"], e["q"])).alias("twice"))
        all_p = F.aggregate(F.map_values(r["words"]), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col("by_word"), F.aggregate(hits, start, add, lambda a: distance(a["twice"] + all_p - a["p"] + term(1 - all_p, 1 - a["q"])) / limit))

    nearest = F.array_min(F.transform(refs, lambda r: F.greatest(class_part(r), word_part(r))))
    out = out.select(*columns, "base_failed", F.round(nearest, 6).alias("divergence"))
    return out.select(*columns, "base_failed", "divergence", (~F.col("base_failed") & (F.coalesce("divergence", F.lit(0.0)) <= 1)).alias("kept"))


def rules_sql(rules: Rules = Rules(languages=16)) -> str:
    """DuckDB SQL of the rows of quality_rules over `documents`; without rules that of up to sixteen languages."""
    most = "" if rules.languages is None else f" LIMIT {rules.languages}"
    size = lambda c: f"length(regexp_replace(t, '[^{c}]+', '', 'g'))".replace("'\\x22", "''\\x22")
    sizes = ", ".join(size(c) for c in CLASSES)
    n = len(CLASSES)
    limit = " ".join(f"WHEN n_words >= {k} THEN {x}" for k, x in reversed(rules.word_limits))
    term_sql = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l, [{sizes}] AS c FROM d),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS times FROM (SELECT rid, i, w[i : i + {WINDOW - 1}] AS v FROM w, unnest(range(1, len(w) - {WINDOW - 2})) AS y(i))),
rep AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM win WHERE times > 1) GROUP BY rid),
b AS (SELECT w.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, list_append(c, length(t) - list_sum(c)) AS cc FROM w LEFT JOIN rep USING (rid)),
lang_words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM b WHERE lang IS NOT NULL) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM lang_words GROUP BY lang ORDER BY total DESC, lang{most}),
rw AS (SELECT lang, word, n / total AS p FROM lang_words JOIN totals USING (lang) WHERE n >= total * {rules.common!r}),
rc AS (SELECT lang, {", ".join(f"sum(cc[{k}]) / sum(length(t)) AS p{k}" for k in range(1, n + 2))} FROM b JOIN totals USING (lang) GROUP BY lang),
held AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM b WHERE n_words >= {rules.word_limits[0][0]}) SEMI JOIN rw USING (word) GROUP BY ALL),
hit AS (SELECT held.rid, rw.lang, sum(p) AS p, sum(held.n / n_words) AS q, sum({term_sql("p", "(held.n / n_words)")}) AS twice FROM held JOIN rw USING (word) JOIN b USING (rid) GROUP BY ALL),
lang_p AS (SELECT totals.lang, coalesce(sum(p), 0) AS p FROM totals LEFT JOIN rw USING (lang) GROUP BY ALL),
parts AS (SELECT b.rid, CASE WHEN length(t) >= {rules.class_characters} THEN sqrt(greatest({" + ".join(term_sql(f"p{k}", f"(cc[{k}] / length(t))") for k in range(1, n + 2))}, 0) / 2) / {rules.class_limit} END AS by_class,
  CASE WHEN n_words >= {rules.word_limits[0][0]} THEN sqrt(greatest(coalesce(hit.twice, 0) + lang_p.p - coalesce(hit.p, 0) + {term_sql("(1 - lang_p.p)", "(1 - coalesce(hit.q, 0))")}, 0) / 2) / (CASE {limit} END) END AS by_word
  FROM b CROSS JOIN rc JOIN lang_p ON lang_p.lang = rc.lang LEFT JOIN hit ON hit.rid = b.rid AND hit.lang = rc.lang WHERE b.lang IS NULL OR b.lang IN (SELECT lang FROM totals)),
near AS (SELECT rid, round(min(greatest(by_class, by_word)), 6) AS divergence FROM parts GROUP BY rid),
f AS (SELECT b.*, divergence, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeated} * n_words AS base_failed FROM b LEFT JOIN near USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, divergence, NOT base_failed AND coalesce(divergence, 0) <= 1 AS kept FROM f
"""
