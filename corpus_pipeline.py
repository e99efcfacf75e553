"""Corpus pipeline: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame
that is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.llm import bpe, classifiers, decontaminate, jaccard, queries, repeats
from epochlake.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, doesn't reject (score >= 0.7).

    Rows are kept as they stand; a text is scored once for each row that repeats it. Null and empty texts score by the
    classifier's bias; columns besides id and text are passed on, whatever their names.
    """
    found = classifiers.quality(docs, read(spark, sf_dir, "labels"), keep=True)
    return found.where("predicted = 1").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Links: similarity of five-word shingles of 0.8 or more. Documents without words link with nothing and stay.
    Documents without an id stay unless they are copies of one with an id; an id that stays keeps all its rows.
    Columns besides id and text are passed on, whatever their names.
    """
    groups = jaccard.near_components(docs, size=5, p=80, q=100)
    # rows of a group that stay: smallest id, or no id in the whole group
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["doc_id"]), "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand more than once; n_chars follows, empty texts go.

    A text that loses nothing stays as it is, white space included; of others the kept words are joined by spaces.
    """
    cut = repeats.remove_repeated_words(docs, keep=True)
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept"))
    out = cut.where(whole | (F.length("kept") > 0)).withColumn("text", text)
    return out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; a null id goes with all rows of null id if one of them holds an item;
    columns besides id and text are passed on, whatever their names.
    """
    found = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding: doc_id, lang, source, ids, n_tokens and digests.

    Null and empty texts have no ids; rows that repeat are encoded each; other columns of docs are left behind.
    """
    coded = bpe.encode(docs, queries.tokenizer_path(), keep=("ids",))
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: No stage but the anti-joins can be said in SQL: the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
