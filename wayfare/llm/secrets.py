"""Secret scans: strong patterns alone, weak candidates only where parts of one credential are close together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import kept, let, text_key

# fixed values: kinds and patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
# parts that tell nothing when alone
KEY = r"[A-Za-z0-9+/_-]{32,}={0,2}"
USER = r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s"'<>]+"""

#: Shorter or single-case keys, for wide linking: letters and digits together.
SHORT = r"[A-Za-z0-9+/_-]{16,}={0,2}"

#: Values of a run in ``running``.
RUN = 256
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """join of the first one, two, ... values (an associative function on bigint), in two levels of RUN values each: an
    array that grows value by value is copied each time, and here none grows beyond a run or the number of runs."""

    def scan(part: Column, start: Column) -> Column:
        step = lambda acc, x: let(F.when(acc["at"].isNull(), x).otherwise(join(acc["at"], x)), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])

    none = F.lit(None).cast("bigint")
    whole = lambda part: F.aggregate(part, none, lambda acc, x: F.when(acc.isNull(), x).otherwise(join(acc, x)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    runs = let(cut, lambda parts: let(scan(F.transform(parts, whole), none), lambda ends: F.flatten(F.transform(parts, lambda p, i: scan(p, F.when(i > 0, F.get(ends, i - 1)))))))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(runs)


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, in order of their starts.

    Both are sorted together once: a span is free if no other one before it ends beyond its start, and none after it
    starts before its end."""
    tagged = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    ends = lambda x: running(F.transform(x, lambda s: F.when(s["own"] == 0, s["stop"]).otherwise(-1).cast("bigint")), F.greatest)
    starts = lambda x: F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s["own"] == 0, s["start"]).otherwise(1 << 31).cast("bigint"))), F.least))
    free = lambda s, end, start: (s["own"] == 1) & (end <= s["start"]) & (start >= s["stop"])

    def picked(x: Column) -> Column:
        judged = F.zip_with(F.zip_with(x, ends(x), lambda s, e: F.struct(s.alias("s"), e.alias("e"))), starts(x), lambda y, t: F.struct(y["s"].alias("s"), free(y["s"], y["e"], t).alias("ok")))
        return F.transform(F.filter(judged, lambda y: y["ok"]), lambda y: F.struct(y["s"]["start"].alias("start"), y["s"]["kind"].alias("kind"), y["s"]["stop"].alias("stop")))

    merged = let(F.sort_array(F.concat(tagged(others, 0), tagged(spans, 1))), picked)
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(merged)


def spans(text: Column, pattern: str, kind: int, good: object = None) -> Column:
    """array of (start, kind, stop) of the leftmost non-overlapping matches, in code points.

    What lies between matches is what split() gives, so places are running sums of lengths.  The work is in proportion
    to the text, however many matches it has."""
    none = F.array().cast(_SPAN)

    def placed(pieces: Column, found: Column) -> Column:
        n = F.transform(found, F.length)
        gaps = F.slice(F.transform(pieces, F.length), F.lit(1), F.size(found))
        at = let(running(F.zip_with(gaps, n, lambda g, m: (g + m).cast("bigint")), lambda x, y: x + y), lambda stops: F.zip_with(stops, n, lambda stop, m: F.struct((stop - m).cast("int").alias("start"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop"))))
        if not good:
            return at
        both = F.zip_with(at, found, lambda s, m: F.struct(s.alias("s"), F.coalesce(good(m), F.lit(False)).alias("ok")))
        return F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: placed(F.split(text, pattern, -1), m))).otherwise(none)


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def _lettered(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts of (doc_id, key, span, role, weak) whose complements start within ``scope`` code points.

    Starts are counted by buckets of the scope's width; for each bucket and role only the least and the greatest
    start matter to a part in the same bucket or the next, so the join gives a part nine rows at most."""
    keyed = parts.withColumn("bucket", F.expr(f"span.start div {scope}"))
    ends = keyed.groupBy("doc_id", "key", "bucket", "role").agg(F.min("span.start").alias("lo"), F.max("span.start").alias("hi"))
    ends = ends.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("_b"), F.col("role").alias("other"), "lo", "hi")
    weak = keyed.filter("weak").distinct()
    near = weak.join(ends, F.expr(f"doc_id <=> _d AND key = _k AND bucket = _b AND role <> other AND hi >= span.start - {scope} AND lo <= span.start + {scope}"))
    seen = near.groupBy("doc_id", "key", "span", "role").agg(F.max((F.col("other") == "id").cast("int")).alias("id"), F.max((F.col("other") == "secret").cast("int")).alias("secret"))
    return seen.filter("(role = 'id' AND secret = 1) OR (role = 'secret' AND id = 1) OR (role = 'end' AND id = 1 AND secret = 1)").select("doc_id", "key", "span")


def _linked_wide(parts: DataFrame, scope: int) -> DataFrame:
    """As _linked, but gaps are measured from the end of one span to the start of the next, an endpoint and a secret
    complete each other, and role "short" (a key that counts only beside an id) completes ids and endpoints with one.

    A span is cut at the buckets' borders, so that two spans are within the scope if a piece of each is, in the same
    bucket or neighbours; the join gives a piece 12 rows at most."""
    pieces = parts.withColumn("bucket", F.explode(F.expr(f"sequence(span.start div {scope}, greatest(span.start, span.stop - 1) div {scope})")))
    pieces = pieces.withColumn("at", F.greatest(F.col("span.start"), F.col("bucket") * scope)).withColumn("to", F.least(F.col("span.stop"), (F.col("bucket") + 1) * scope))
    ends = pieces.groupBy("doc_id", "key", "bucket", "role").agg(F.min("at").alias("lo"), F.max("to").alias("hi"))
    ends = ends.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("_b"), F.col("role").alias("other"), "lo", "hi")
    weak = pieces.filter("weak").distinct()
    near = weak.join(ends, F.expr(f"doc_id <=> _d AND key = _k AND bucket = _b AND role <> other AND hi >= at - {scope} AND lo <= to + {scope}"))
    has = lambda role: F.max((F.col("other") == role).cast("int")).alias(f"n_{role}")
    seen = near.groupBy("doc_id", "key", "span", "role").agg(has("id"), has("secret"), has("short"), has("end"))
    fits = "(role = 'id' AND n_secret + n_short > 0) OR (role = 'secret' AND n_id + n_end > 0) OR (role = 'short' AND n_id = 1) OR (role = 'end' AND (n_secret = 1 OR n_id + n_short = 2))"
    return seen.filter(fits).select("doc_id", "key", "span")


def scan_secrets(docs: DataFrame, *, scope: int = 200, wide: bool = False) -> DataFrame:
    """doc_id, text_key, base and found: arrays of (start, kind, stop) of the base patterns and of all; one row for
    each row of ``docs``.

    Weak candidates are runs of 32 or more mixed characters (kind key), account names (user) and endpoints.  A name
    is reported if a secret starts within ``scope`` code points, a key if a name or an access identifier does, and
    an endpoint if both do.  With ``wide``, an endpoint and a secret (a key too) complete each other without a name; runs
    of 16 or more letters and digits are keys beside a name or an access identifier; and the scope counts from the end
    of one span to the start of the next.  Texts are searched as a whole, however long.  A null text is an empty one; rows of
    one id and text get equal results; null ids are ids like any other; an empty table gives an empty result.  Only doc_id and text are read, so other columns cannot
    clash."""
    text, none = F.col("_t"), F.array().cast(_SPAN)
    flat = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("_t"))
    scanned = flat.select(
        "doc_id", "key",
        spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("assign"),
        spans(text, ACCESS, 1).alias("access"),
        spans(text, HEX, 2).alias("hex"),
        spans(text, SHORT if wide else KEY, 3, _lettered if wide else _mixed).alias("k"),
        (spans(text, KEY, 3, _mixed) if wide else none).alias("long"),
        spans(text, USER, 4).alias("user"),
        spans(text, ENDPOINT, 5).alias("endpoint"),
    )
    # a candidate inside a base match is no other secret
    base = F.sort_array(F.concat("assign", "access", "hex"))
    free = lambda c: apart(c, F.concat("assign", "access", "hex"))
    scanned = kept(scanned.select("doc_id", "key", base.alias("base"), "assign", "access", "hex", free(F.col("k")).alias("k"), free(F.col("user")).alias("user"), "endpoint", free(F.col("long")).alias("long")))
    if wide:  # what is part of an endpoint or a name is no short key beside it
        scanned = scanned.withColumn("short", apart(F.col("k"), F.concat("user", "endpoint", "long"))).withColumn("k", F.col("long"))
    tagged = lambda c, role, weak: F.transform(F.col(c), lambda s: F.struct(s.alias("span"), F.lit(role).alias("role"), F.lit(weak).alias("weak")))
    keys = [("k", "secret", True), ("short", "short", True)] if wide else [("k", "secret", True)]
    every = F.concat(*[tagged(c, role, weak) for c, role, weak in (("assign", "secret", False), ("hex", "secret", False), ("access", "id", False), *keys, ("user", "id", True), ("endpoint", "end", True))])
    parts = scanned.filter(" + ".join(f"size({c})" for c in ([k for k, _, weak in keys if weak] + ["user", "endpoint"])) + " > 0").select("doc_id", "key", F.explode(every).alias("x")).select("doc_id", "key", "x.*")
    more = (_linked_wide if wide else _linked)(parts, scope).groupBy("doc_id", "key").agg(F.collect_set("span").alias("more")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "more")
    out = scanned.join(more, F.expr("doc_id <=> _d AND key = _k"), "left")
    return out.select("doc_id", F.col("key").alias("text_key"), "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("found"), *[F.size(c).cast("bigint").alias(f"n_{c}") for c in KINDS[:3]])


def secret_digests(docs: DataFrame, *, scope: int = 200, wide: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:stop by start and then kind)."""
    found = scan_secrets(docs, scope=scope, wide=wide)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))
