"""One query for each operator, over whole tables, and SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lines, near, pieces, quality, secrets, tokens, toxicity, urls
from .sql import SQL
from .text import scratch, table

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("WAYFARE_TOKENIZERS", "/opt/tokenizers")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    judged = quality.quality_rules(docs, labels, threshold=None, carried=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.digest(F.col("items")).alias("items_sha256"), "contaminated")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, grade, toxic.  Grades of the labels: 0 fine, 1 poor but not toxic, 2 toxic."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("toxic") == 0, 1 - F.coalesce("quality", F.lit(1)))
    model = toxicity.fit_toxicity(docs, labels.select("doc_id", grade.alias("grade")), n_grades=3, toxic_from=2)
    return toxicity.score_toxicity(docs, model, toxic_from=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of the cleaned text; null for a null one)."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict.  A page's outcome is that of the document of the same number: bad if its
    label says 0."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    outcomes = table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return urls.filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secrets.secret_digests(table(spark, sf_dir, "documents", "doc_id", "text"), wide=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, counted in flat token files of the whole table."""
    from public_tokenizers import PATTERN

    ranks = pieces.model_bytes(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.count_tokens(docs, scratch(spark, "tokens"), ranks, PATTERN, eod=50256)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, n_copies, chat_sha256."""
    chats = chat.format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return chats.select("conv_id", "n_turns", "n_copies", F.sha2("chat", 256).alias("chat_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links from a similarity of 0.85 on."""
    found = near.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return pieces.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"), pieces.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_token_counts": op7_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_sentencepiece": op10_sentencepiece,
}

__all__ = ["QUERIES", "SQL"]
