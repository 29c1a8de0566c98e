"""Line dedup by distinct-site spread: sketches first, exact counts near the threshold, then removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, kept, text_key


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _exploded(docs: DataFrame) -> DataFrame:
    """doc_id, key, source, pos, h: the lines with a word, as they are but for white space at their ends, by a 128-bit hash."""
    at = docs.select("doc_id", text_key(F.col("text")).alias("key"), "source", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return at.select("doc_id", "key", "source", "pos", trimmed(F.col("line")).alias("line")).filter("line <> ''").select("doc_id", "key", "source", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("h"))


def boilerplate(docs: DataFrame, *, min_sites: int = 10, band: float = 0.3, lg_k: int = 12) -> DataFrame:
    """(h, first): hashes of the lines on ``min_sites`` distinct sites or more, each with its first place.

    A HyperLogLog sketch of the sites of each line is merged by aggregation, so a line that is everywhere costs no
    more than any other.  Where the estimate lies within ``band`` of the threshold (with 2^12 registers that is over
    15 standard errors), the sites are counted exactly instead."""
    at = _exploded(docs)
    spread = at.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("source", lg_k)).alias("sites"),
        F.min(F.struct("doc_id", "key", "pos")).alias("first"),
    )
    wide = kept(spread.filter(F.col("sites") >= min_sites * (1 - band)))
    sure = wide.filter(F.col("sites") > min_sites * (1 + band)).select("h", "first")
    close = wide.filter(F.col("sites") <= min_sites * (1 + band)).select("h", "first")
    # a line's sites first: one that is everywhere is some rows only when lines are brought together
    pairs = at.filter(F.col("source").isNotNull()).select("h", "source").distinct()
    exact = pairs.join(close.select("h"), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return sure.unionByName(close.join(exact.filter(F.col("n") >= min_sites).select("h"), "h", "left_semi"))


def dedup_lines(docs: DataFrame, *, min_sites: int = 10, band: float = 0.3, lg_k: int = 12) -> DataFrame:
    """The columns of ``docs`` with the cleaned text, and n_lines, n_removed.

    Lines found on ``min_sites`` sites (values of source) or more go, but for their first place: the least doc_id and
    then the least position, so that a copied passage stays once.  n_lines counts lines with a word.  Blank lines
    stay.  A null text stays null and has no lines; a null source is no site; a null doc_id comes before all others.
    Rows of one id and text are treated alike, first places included; an empty table gives an empty result.  Columns
    named n_lines or n_removed are replaced."""
    flagged = kept(boilerplate(docs, min_sites=min_sites, band=band, lg_k=lg_k))
    at = _exploded(docs).select("doc_id", "key", "pos", "h").join(flagged, "h")
    there = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    gone = at.filter(~there).groupBy("doc_id", "key").agg(F.collect_set("pos").alias("_gone")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "_gone")
    base = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")]).withColumn("_key", text_key(F.col("text")))
    out = base.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    rest = F.array_join(F.filter(split_lines(F.col("text")), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    n_lines = F.size(F.filter(split_lines(F.col("text")), lambda x: trimmed(x) != "")).cast("bigint")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest)
    return out.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in base.columns if c != "_key"],
        n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
