"""Registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotstream.llm import (
    context_tree, decontamination, filter_audit, hard_negatives, html_content, language, licenses, line_dedup,
    line_rules, near_duplicates, pieces, sharding, sql, token_counts,
)
from shotstream.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(function):
    QUERIES[function.__name__] = function
    return function


@_register
def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, and the digest of its cleaned text."""
    return line_rules.line_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bad_lines", "lost_chars", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"),
    )


@_register
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn(
        "similarity", F.round("similarity", 6)
    )


@_register
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


@_register
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the context tree, and the word baseline."""
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


@_register
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.predict_language(table(spark, sf_dir, "documents"))


@_register
def op9_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_content.extract_text(table(spark, sf_dir, "pages"))


@_register
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the digest of what they decode to."""
    return pieces.encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "ids", "n_pieces", "n_byte_pieces", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5")
    )


@_register
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after e-mail addresses and long numbers are replaced."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted",
        F.md5(F.col("edited_text").cast("binary")).alias("edited_md5"),
    )


@_register
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@_register
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates.duplicate_classes(table(spark, sf_dir, "documents"))


@_register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go because a smaller id holds them, and the digest of the rest."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@_register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    rows = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(hard_negatives.taking_part(rows))


@_register
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every step of every order of the five filters, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op3_line_rules"] = sql.line_rules()
ORACLES["op5_decontaminate"] = sql.decontamination()
ORACLES["op6_shards"] = sql.shards()
ORACLES["op11_line_dedup"] = sql.line_dedup()
ORACLES["op12_hard_negatives"] = sql.hard_negatives()
ORACLES["op13_filter_audit"] = sql.filter_audit()
