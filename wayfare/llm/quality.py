"""Quality rules: hashed n-gram log-likelihood ratio of trusted against raw text, after plain rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, SPACES, UPPER, let, scratch, space_words

#: Weights are whole numbers of 2^-20 nats, so that sums do not depend on the order of the rows.
UNIT = 1 << 20
#: The least mean ratio to be kept where none is derived, and the least that is derived.  Labelled good texts stay above
#: it even in corpora of some hundred rows.
THRESHOLD = -0.05
#: Buckets of n-grams in small corpora.
LEAST_BUCKETS = 4096
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr")


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on: of runs twice as long, if step is their length."""
    return let(hashes, lambda h: let(F.greatest(F.size(h) - step, F.lit(0)), lambda n: F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))))


def _ngrams(words: Column, buckets: int) -> Column:
    """Bucket numbers of all lower-cased words and of all pairs of neighbours."""
    return let(
        F.transform(words, lambda w: F.xxhash64(F.translate(w, UPPER, LOWER))),
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
            F.transform(_joined(h, 1), lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
        ),
    )


def _covered(hashes: Column, width: int) -> Column:
    """How many words the windows cover whose hash is there twice or more."""

    def positions(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a null neighbour makes "or" null where the other side is false, and true where it is true
    steps = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return let(pairs, lambda s: let(positions(s), lambda p: F.aggregate(steps(p), F.lit(0), lambda acc, x: acc + x)))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` (a power of two) words that the text holds twice or more, the first one
    included."""
    hashed, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashed, step = _joined(hashed, step), 2 * step
    return let(hashed, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, width)))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def trusted_ids(labels: DataFrame, at_most: int = 50_000) -> DataFrame:
    """Ids of trusted rows: those labelled 1, at most ``at_most`` of them, picked by a hash of the id.

    That bound is the only sample here, and what makes the ids safe to broadcast."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)


def buckets_for(docs: DataFrame) -> int:
    """A power of two from LEAST_BUCKETS on, at least a quarter of the root of the corpus' length in characters.

    The number of different n-grams grows slower than the text, and the weights are sent to every task: at 100 TB they
    are 4 million whole numbers."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("n")).first().n
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1.0, math.sqrt(chars) / 4))))


def fit_weights(docs: DataFrame, labels: DataFrame, buckets: int | None = None, at_most: int = 50_000) -> str:
    """ln(p_trusted / p_raw) of each bucket in units of 2^-20, from add-one counts over the whole table, joined by commas.

    The result has one number a bucket; their number is ``buckets`` or follows from the corpus' length."""
    spark = docs.sparkSession
    buckets = buckets_for(docs) if buckets is None else buckets
    trusted = trusted_ids(labels, at_most).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_trusted"))
    counts = (
        docs.select("doc_id", space_words(F.col("text")).alias("_w"))
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")
        .select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(_ngrams(F.col("_w"), buckets)).alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    )
    every = spark.range(buckets).select(F.col("id").cast("int").alias("i")).join(counts, F.col("i") == F.col("b"), "left")
    every = every.select("i", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), (F.coalesce("target", F.lit(0)) + 1).alias("target"))
    # all numbers of one array stand in one row: 16 bytes a bucket
    lists = every.agg(F.array_sort(F.collect_list(F.struct("i", "raw", "target"))).alias("x"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = lambda x: F.round(UNIT * (F.log(x["target"] / F.col("n_target")) - F.log(x["raw"] / F.col("n_raw")))).cast("bigint").cast("string")
    return lists.select(F.array_join(F.transform("x", ratio), ",").alias("w")).first().w


def _scored(docs: DataFrame, weights: str, min_words: int, max_repeat_pct: int) -> DataFrame:
    """The columns of ``docs``, those of the rules, and ``llr``."""
    table = F.split(F.lit(weights), ",").cast("array<bigint>")
    text = F.coalesce(F.col("text"), F.lit(""))
    total = let(_ngrams(F.col("_w"), weights.count(",") + 1), lambda b: F.struct(F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + F.get(table, x)).alias("s"), F.size(b).alias("n")))
    scored = docs.withColumn("_w", space_words(F.col("text"))).select(
        *[c for c in docs.columns if c not in (*RESULTS, "kept")],
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        repeated_lines(text).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("bigint").alias("n_repeat_words"),
        total.alias("_t"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    llr = F.when(F.col("_t.n") > 0, F.expr("_t.s div _t.n")).otherwise(F.lit(0).cast("bigint"))
    return scored.withColumn("base_failed", failed).withColumn("llr", llr).drop("_t")


def least_of_good(scored: DataFrame, labels: DataFrame) -> int:
    """The least ``llr`` of the rows labelled 1 that pass the plain rules, but not less than THRESHOLD; THRESHOLD if
    there are none."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    least = scored.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi").agg(F.min("llr").alias("least")).first().least
    floor = round(THRESHOLD * UNIT)
    return floor if least is None else max(floor, least)


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, buckets: int | None = None, at_most: int = 50_000, threshold: float | None = THRESHOLD,
    min_words: int = 20, max_repeat_pct: int = 30, carried: list[str] | None = None,
) -> DataFrame:
    """The columns of ``docs`` (or the ``carried`` ones) and those of the rules, ``llr`` and ``kept``.

    ``llr`` is the mean over a text's word unigrams and bigrams of the log-likelihood ratio between trusted text and
    the raw corpus, in units of 2^-20; a row is kept if it passes the plain rules and ``llr`` is at least ``threshold``.
    Where that is None, it is the least ``llr`` of all rows labelled 1 that pass the plain rules, though never less than
    THRESHOLD; the scores are then written to the shared folder, so that they are computed once.  The weights' number
    grows with the corpus (``buckets_for``) unless ``buckets`` is given.

    A null or blank text has no words and fails.  Each row is judged by itself, so repeated rows get equal results;
    an empty table gives an empty result; without trusted rows all weights are nearly flat and only the plain rules
    decide.  Columns of ``docs`` with the names of results are replaced."""
    weights = fit_weights(docs, labels, buckets, at_most)
    scored = _scored(docs, weights, min_words, max_repeat_pct)
    scored = scored if carried is None else scored.select(*carried, *RESULTS)
    if threshold is None:
        folder = scratch(docs.sparkSession, "quality")
        scored.write.parquet(folder)
        scored = docs.sparkSession.read.parquet(folder)
        least = least_of_good(scored, labels)
    else:
        least = round(threshold * UNIT)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
