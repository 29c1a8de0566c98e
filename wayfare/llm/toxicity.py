"""Toxicity: cumulative-link ordinal regression on sparse features of a text.

The features are its words and their beginnings of four to six letters, each at two levels: there at all; and there
twice or more and in one of a hundred words or more, which is what tells abuse from a word met by chance."""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, MARKS, UPPER, kept

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
HEADS = (4, 5, 6)
_FOLD = str.maketrans(UPPER + MARKS, LOWER + " " * len(MARKS))


def features(text: str | None, known: Container[str] | None = None) -> set[str]:
    """Features of a text: "word$" or "head", with "+" at their end for the second level.  known: the words and heads
    that matter."""
    words = (text or "").translate(_FOLD).split(" ")
    counts: dict[str, int] = defaultdict(int)
    n = 0
    for w, k in Counter(words).items():
        if not w:
            continue
        n += k
        for g in (w + "$", *[w[:i] for i in HEADS if len(w) >= i]):
            if known is None or g in known:
                counts[g] += k
    return set(counts) | {g + "+" for g, k in counts.items() if k >= 2 and 100 * k >= n}


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = s(weights . features - cuts[k - 1]): one set of weights for all cuts, which ascend."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    @functools.cached_property
    def known(self) -> frozenset[str]:
        return frozenset(g.rstrip("+") for g in self.weights)

    def exceed(self, text: str | None) -> list[float]:
        z = math.fsum(sorted(map(self.weights.__getitem__, features(text, self.known) & self.weights.keys())))
        return [1 / (1 + math.exp(min(700.0, c - z))) for c in self.cuts]


def fit_ordinal(rows: list[tuple[int, list[int]]], n_words: int, n_grades: int, *, l2: float = 1e-5, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by maximum likelihood with a ridge; rows: (grade, word numbers)."""
    y = np.array([g for g, _ in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    col = np.array([i for _, x in rows for i in x], np.int64)
    above = (y[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    w, cuts = np.zeros(n_words), np.sort(np.log(1 - share) - np.log(share))
    # first cut, then logs of the gaps, so that cuts keep their order
    t = np.append(cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2)))
    m, v, p = np.zeros(n_words + len(t)), np.zeros(n_words + len(t)), np.append(w, t)
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w, t = p[:n_words], p[n_words:]
        gaps = np.exp(t[1:])
        cuts = t[0] + np.append(0, np.cumsum(gaps))
        z = np.bincount(row, w[col], len(rows)) if len(col) else np.zeros(len(rows))
        # probabilities of reaching each grade, with 1 below and 0 beyond
        e = np.column_stack([np.ones(len(y)), s(z[:, None] - cuts[None, :]), np.zeros(len(y))])
        d = e * (1 - e)
        at = np.arange(len(y))
        like = np.maximum(e[at, y] - e[at, y + 1], 1e-12)
        gz = -(d[at, y] - d[at, y + 1]) / like / len(y)
        gc = np.zeros((len(y), n_grades + 1))
        gc[at, y] += d[at, y] / like
        gc[at, y + 1] -= d[at, y + 1] / like
        gcut = gc[:, 1:-1].sum(axis=0) / len(y)
        gt = np.append(gcut.sum(), gaps * np.cumsum(gcut[::-1])[::-1][1:])
        g = np.append((np.bincount(col, gz[row], n_words) if len(col) else np.zeros(n_words)) + l2 * w, gt)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, t = p[:n_words], p[n_words:]
    return w, t[0] + np.append(0, np.cumsum(np.exp(t[1:])))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([sorted(features(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))], ["grade", "w"])


def fit_toxicity(docs: DataFrame, grades: DataFrame, *, n_grades: int, toxic_from: int = 1, sample: int = SAMPLE, min_docs: int = 5, min_gain: float = 25.0) -> OrdinalModel:
    """Fits on at most ``sample`` rows with a grade (0 to n_grades - 1), picked by a hash of the id.

    The vocabulary is all features of ``min_docs`` of those texts or more that tell about a grade of ``toxic_from`` or
    more by a G-test of ``min_gain`` or more; what the driver gets is bounded by the sample.  Rows of grades without a
    text in ``docs`` are left out; all of the rows that share an id in ``docs`` count."""
    ids = grades.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("grade"))
    rows = kept(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("grade", "text").mapInArrow(_featured, "grade int, w array<string>"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("grade") >= toxic_from).cast("int")), F.lit(0)).alias("bad")).first()
    n, bad = total.n, int(total.bad)
    if not n or not 0 < bad < n:
        return OrdinalModel({}, (math.inf if not bad else -math.inf,) * (n_grades - 1))
    counts = rows.select("grade", F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum((F.col("grade") >= toxic_from).cast("double")).alias("b")).filter(F.col("c") >= min_docs)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    c, b = F.col("c"), F.col("b")
    g = term(b, c * bad / n) + term(c - b, c * (n - bad) / n) + term(bad - b, (n - c) * bad / n) + term((n - bad) - (c - b), (n - c) * (n - bad) / n)
    best = counts.select("word", F.round(g, 6).alias("g")).filter(F.col("g") >= min_gain)
    words = sorted(r.word for r in best.collect())
    known = F.broadcast(docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, i int")) if words else None
    if known is None:
        return OrdinalModel({}, (math.inf,) * (n_grades - 1))
    seen = rows.withColumn("r", F.monotonically_increasing_id()).select("r", "grade", F.explode_outer("w").alias("word")).join(known, "word", "left").groupBy("r", "grade").agg(F.collect_list("i").alias("x"))
    fitted = sorted((r.grade, sorted(r.x)) for r in seen.select("grade", "x").collect())
    w, cuts = fit_ordinal(fitted, len(words), n_grades)
    return OrdinalModel({x: float(v) for x, v in zip(words, w, strict=True)}, tuple(map(float, cuts)))


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, toxic_from: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (the expected grade, to six places), grade (the highest k with P(grade >= k) of ``threshold``
    or more) and toxic (a grade of ``toxic_from`` or more): one row for each row.

    A null or empty text has no features and gets the score of none.  Repeated rows get equal scores; an empty table
    gives an empty result; without labels of both kinds no word weighs anything.  Only doc_id and text are read, so
    other columns cannot clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.exceed(t) for t in b.column("text").to_pylist()]
            grade = [sum(p >= threshold for p in s) for s in scores]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([round(sum(s), 6) for s in scores], pa.float64()), pa.array(grade, pa.int32()), pa.array([g >= toxic_from for g in grade], pa.bool_())], ["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, severity double, grade int, toxic boolean")
