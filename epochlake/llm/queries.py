"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, classifiers, decontaminate, divergence, hnsw, html, jaccard, licenses, merkle, repeats
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a 100-byte string covers which also starts earlier."""
    return repeats.remove_later_bytes(read(spark, sf_dir, "documents")).drop("kept")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels outside the held-out fold."""
    return classifiers.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a document holds, with the best matching place of each template."""
    return licenses.licences(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with their similarity."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the number of their links, their group, and whether they stay."""
    return hnsw.vector_links(read(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words that a 35-word window covers which stands elsewhere too."""
    return repeats.remove_repeated_words(read(spark, sf_dir, "documents")).drop("kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels outside the held-out fold."""
    return classifiers.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the size of their shingle set and the group of near copies they belong to."""
    return jaccard.near_components(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's token ids and of what they decode to."""
    return bpe.digest(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and inclusion proof of every document, and whether the proof holds after tampering."""
    return merkle.checked_proofs(read(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats, symbols and lengths of every document, and whether its distributions are those of a language."""
    return divergence.quality_rules(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups into which two tokenizers' ids of every document fall, and how usual their links are in the corpus."""
    return align.alignment(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_html, op3_toxicity, op4_license_scan, op5_decontamination, op6_embedding_dedup, op7_substring_dedup, op8_quality, op9_ngram_join, op10_bpe, op11_merkle, op12_quality_rules, op13_alignment)}

ORACLES: dict[str, str] = {"op4_license_scan": licenses.licence_sql(), "op11_merkle": merkle.proofs_sql(), "op12_quality_rules": divergence.rules_sql()}
