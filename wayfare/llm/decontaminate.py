"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import kept, plain_words, text_key, windows

#: Item windows are broadcast while they take so many bytes at most; more are joined by a shuffle.
BROADCAST_BYTES = 128 << 20
#: What a window takes besides its text, which is held three times: rows of hashes, keys and headers.
WINDOW_BYTES = 600


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct (item_id, win): the runs of ``width`` words of each item; all its words where there are fewer."""
    w = items.select("item_id", plain_words(F.col("text")).alias("w")).filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    wins = F.when(F.size("w") < width, F.array(F.array_join("w", " "))).otherwise(windows(F.col("w"), width, lambda s: F.array_join(s, " ")))
    return w.select("item_id", F.explode(wins).alias("win")).distinct()


def _shingled(words: Column, k: int) -> Column:
    """Hashes of the runs of k words, each with its length, so that runs of different lengths do not meet."""
    return F.coalesce(windows(words, k, lambda s: F.xxhash64(s)), F.array().cast("array<bigint>"))


def find_windows(docs: DataFrame, items: DataFrame, *, width: int = 8, shingle: int = 4, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Occurrences (doc_id, key, start, len, win) of item windows in ``docs``; start counts words from 0.

    A window occurs only where each of its shingles does, so one is enough to look for: the rarest over the whole
    corpus.  Documents are joined on that prefix; a candidate must lie inside the document (position and length
    bounds), and then all its words are compared."""
    wins = _item_windows(items, width).select("win").distinct()
    size = wins.agg(F.coalesce(F.sum(3 * F.octet_length("win").cast("bigint") + WINDOW_BYTES), F.lit(0)).alias("n")).first().n
    small = size <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    parts = wins.select("win", F.split("win", " ").alias("w")).select("win", F.size("w").alias("len"), F.least(F.size("w"), F.lit(shingle)).alias("k"), "w")
    lengths = sorted(r.k for r in parts.select("k").distinct().collect())  # 1 to ``shingle``
    each = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in lengths:
        each = each.when(F.col("k") == k, _shingled(F.col("w"), k))
    tokens = parts.select("win", "len", F.posexplode(each).alias("offset", "h")) if lengths else parts.select("win", "len", F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("h"))

    words = docs.select("doc_id", text_key(F.col("text")).alias("key"), plain_words(F.col("text")).alias("words"))
    all_of = F.concat(*[F.transform(_shingled(F.col("words"), k), lambda h, i: F.struct(i.alias("i"), h.alias("h"))) for k in lengths]) if lengths else F.array().cast("array<struct<i:int,h:bigint>>")

    # how often the corpus holds each shingle of the benchmark
    seen = words.select(F.explode(F.concat(*[_shingled(F.col("words"), k) for k in lengths]) if lengths else F.array().cast("array<bigint>")).alias("h"))
    seen = seen.join(hint(tokens.select("h").distinct()), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rare = tokens.join(seen, "h").groupBy("win", "len").agg(F.min(F.struct("n", "h", "offset")).alias("p"), F.count(F.lit(1)).alias("found"))
    # a window with a shingle that no document holds is nowhere
    full = tokens.groupBy("win").agg(F.count(F.lit(1)).alias("there"))
    prefix = rare.join(full, "win").filter(F.col("found") == F.col("there")).select("win", "len", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), F.split("win", " ").alias("w"))

    at = words.select("doc_id", "key", "words", F.size("words").alias("n"), all_of.alias("s"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))
    if small:  # the words ride along by reference: only rows with a partner are ever built
        hit = (
            at.select("doc_id", "key", "words", "n", F.explode("s").alias("s"))
            .select("doc_id", "key", "words", "n", F.col("s.i").alias("i"), F.col("s.h").alias("h"))
            .join(F.broadcast(prefix), "h")
            .withColumn("start", F.col("i") - F.col("offset"))
            .filter(inside & (F.slice("words", F.col("start") + 1, F.col("len")) == F.col("w")))
        )
        return hit.select("doc_id", "key", "start", "len", "win")
    cand = (
        at.select("doc_id", "key", "n", F.explode("s").alias("s"))
        .select("doc_id", "key", "n", F.col("s.i").alias("i"), F.col("s.h").alias("h"))
        .join(prefix, "h")
        .withColumn("start", F.col("i") - F.col("offset"))
        .filter(inside)
        .select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "start", "len", "win", "w")
    )
    back = words.join(cand, words.doc_id.eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    return back.filter(F.slice("words", F.col("start") + 1, F.col("len")) == F.col("w")).select("doc_id", "key", "start", "len", "win")


def _covered(spans: Column) -> Column:
    """Words under spans (start, len), each counted once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 8, min_items: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, key, n_words, n_hit, items (array of ids), contaminated: one row for each row of ``docs``.

    A document word is hit if it lies in an occurrence of a window of an item; a document is contaminated from
    ``min_items`` items with occurring windows on.  Null or empty texts have no words; null ids are ids like any
    other; rows of one id and text get equal results; items without an id or words are ignored; without items
    nothing is hit.  Only doc_id and text, item_id and text are read, so other columns cannot clash."""
    found = kept(find_windows(docs, items, width=width, broadcast_bytes=broadcast_bytes).distinct())  # read twice
    spans = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.sort_array(F.collect_set("win")).alias("wins"))
    # items of each distinct set of windows: documents that share a passage don't meet its items one by one
    sets = spans.select("wins").distinct()
    owned = sets.select("wins", F.explode("wins").alias("win")).join(_item_windows(items, width), "win").groupBy("wins").agg(F.collect_set("item_id").alias("items"))
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(plain_words(F.col("text"))).cast("bigint").alias("n_words"))
    both = spans.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), _covered(F.col("spans")).cast("bigint").alias("hit"), "wins").join(owned, "wins")
    out = base.join(both, F.expr("doc_id <=> d and key = k"), "left")
    none = F.array().cast(both.schema["items"].dataType)
    return out.select(
        "doc_id", "key", "n_words", F.coalesce("hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        (F.coalesce(F.size("items"), F.lit(0)) >= min_items).alias("contaminated"),
    )


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.transform(items, lambda x: x.cast("string"))), ","), 256)


__all__ = ["decontaminate", "digest", "find_windows"]
