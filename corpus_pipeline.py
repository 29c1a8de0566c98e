"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents.  Only doc_id, text and source are read from docs; other columns pass through, with n_chars
brought up to date.  Empty tables give empty results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, lines, near, pieces, quality
from wayfare.llm.queries import TOKENIZERS
from wayfare.llm.text import dropped, scratch, stored, table, text_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the rules; a null or empty text fails them.  Repeated rows stay or go together."""
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=None)
    return judged.filter("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand on ten sites or more, but for their first places, and rows all of whose lines went.

    A null text and one without lines stay as they are."""
    cleaned = lines.dedup_lines(docs, min_sites=10).filter("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", n_chars)
    return cleaned.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each group of texts with a similarity of 0.8 or more.

    Rows that share an id are one document, of which one row stays; rows without an id all stay."""
    found = near.near_duplicates(docs, percent=80).filter("kept AND doc_id IS NOT NULL")
    chosen = stored(found.groupBy(F.col("component_id").alias("_d")).agg(F.min("text_key").alias("_k")))  # a query of its own: the driver holds less at once
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    stay = keyed.join(chosen, (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left_semi").dropDuplicates(["doc_id", "_key"])
    return stay.unionByName(keyed.filter("doc_id IS NULL")).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of any benchmark item: a passage of one item is a leak too."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), min_items=1)
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti").select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids: one row for each row; a null text is an empty one, with the end id only."""
    encoded = pieces.encode_ids(docs, pieces.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


def decoded(rows: DataFrame) -> DataFrame:
    """The columns of the last stage and text: what its ids decode to, row by row."""
    return pieces.with_decoded(rows, pieces.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("decontamination", decontaminate_stage),
    ("sentencepiece", encode_stage),
]

#: SQL can't express the stages' hashes and tokenizer; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again, and the text decoded from the ids.

    A stage's rows are deleted once those of the next are written; the last ones stay until the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return decoded(docs)
