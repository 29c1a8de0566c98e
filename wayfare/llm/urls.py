"""URL filters: explicit rules, then host reputation by empirical Bayes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER, kept

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Some suffixes of two labels under which names are registered; whole lists are a parameter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")
#: A prior weighs as so many pages at least and at most.
LEAST, MOST = 0.5, 10_000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _name(host: Column) -> Column:
    """A host without user, port and dots at its end; an address in brackets keeps them."""
    bare = F.element_at(F.split(host, "@"), -1)
    return F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"\.+$", "")


def _levels(hosts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Adds suffix and domain (the suffix and one more label) to rows with a host.

    ``suffixes`` are rules of public suffix lists: plain ones, "*.x" for all names under x, and "!y.x" for an exception
    to that.  The longest rule that fits decides, an exception before all others; without one the last label is the
    suffix.  Numeric addresses are their own suffix and domain, and so is a host that is a suffix itself."""
    spark = hosts.sparkSession
    known = spark.range(1).select(F.explode(F.split(F.lit("\n".join(sorted(set(suffixes)))), "\n")).alias("_rule"))  # as long as the parameter
    named = hosts.select("host").distinct().withColumn("_a", F.split(_name(F.col("host")), r"\."))
    tails = named.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("_a")), lambda k: F.slice(F.col("_a"), -k, k))).alias("_t"))
    tail, rest = F.array_join("_t", "."), F.array_join(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(1))), ".")
    asked = tails.select("host", F.size("_t").alias("_n"), F.explode(F.array(tail, F.when(F.size("_t") > 1, F.concat(F.lit("*."), rest)).otherwise(F.lit("*")), F.concat(F.lit("!"), tail))).alias("_q"))
    hit = asked.join(F.broadcast(known), F.col("_q") == F.col("_rule"))
    best = hit.groupBy(F.col("host").alias("_h")).agg(F.max(F.when(F.col("_rule").startswith("!"), F.col("_n") - 1)).alias("_except"), F.max("_n").alias("_longest"))
    k = F.greatest(F.coalesce("_except", "_longest", F.lit(1)), F.lit(1))
    last = lambda n: F.array_join(F.slice(F.col("_a"), F.greatest(F.size("_a") - n + 1, F.lit(1)), n), ".")
    address = _name(F.col("host")).rlike(r"^(\d+(\.\d+){3}|\[.*\])$")
    whole = _name(F.col("host"))
    levels = named.join(best, F.col("host") == F.col("_h"), "left").select(
        F.col("host").alias("_h"), F.when(address, whole).otherwise(last(k)).alias("suffix"), F.when(address, whole).otherwise(last(k + 1)).alias("domain")
    )
    return hosts.join(levels, F.col("host") == F.col("_h")).drop("_h")


def _spread(children: DataFrame, above: list[str]) -> DataFrame:
    """One row (num, den): the correlation of outcomes within a child of the groups ``above`` is num / den.

    That is the moment estimate of the beta-binomial's dispersion: the sum of squares between the children of one
    parent, less what chance alone would give, over what full correlation would add."""
    seen = children.filter("n > 0")
    of = seen.groupBy(*above).agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.sum(F.col("n").cast("double") * F.col("n")).alias("Q"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("W"), F.count(F.lit(1)).alias("K"))
    v = F.col("B") / F.col("N") * (1 - F.col("B") / F.col("N"))
    num = F.col("W") - F.col("B").cast("double") * F.col("B") / F.col("N") - v * (F.col("K") - 1)
    den = v * ((F.col("N") - F.col("Q") / F.col("N")) - (F.col("K") - 1))
    return of.agg(F.sum(num).alias("num"), F.sum(den).alias("den"))


def _strength(num: float | None, den: float | None, unknown: float) -> float:
    """How many pages a prior weighs as: 1 / correlation - 1, within LEAST and MOST; ``unknown`` where the data have no
    two children with outcomes under one parent."""
    if num is None or den is None or den <= 1e-12:
        return unknown
    rho = num / den
    return MOST if rho <= 1 / (1 + MOST) else max(LEAST, 1 / rho - 1)


def _lgamma(z: Column) -> Column:
    """ln of the gamma function: Stirling's series eight places on."""
    w = z + 8
    series = (w - 0.5) * F.log(w) - w + 0.9189385332046727 + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)
    return series - sum((F.log(z + i) for i in range(1, 8)), F.log(z))


def beta_below(x: float, a: Column, b: Column) -> Column:
    """P(X <= x) of X ~ Beta(a, b) with a mean over x, by the series whose terms fall by x (a + b + k) / (a + 1 + k).

    Terms are added until the rest is under 1e-12 of the sum; their number grows with the root of a."""
    first = F.lit(x) * (a + b) / (a + 1)
    n = F.ceil(F.least(30 / (1 - first), F.sqrt(86 * (a + 1) / (1 - x)))).cast("int") + 60

    def step(acc: Column, k: Column) -> Column:
        t = acc["t"] * x * (a + b + k - 1) / (a + k)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    one = F.lit(1.0)
    total = F.aggregate(F.sequence(F.lit(1), n), F.struct(one.alias("t"), one.alias("s")), step, lambda acc: acc["s"])
    return total * F.exp(a * math.log(x) + b * math.log1p(-x) + _lgamma(a + b) - _lgamma(a + 1) - _lgamma(b))


def host_reputation(pages: DataFrame, outcomes: DataFrame, *, suffixes: Sequence[str] = SUFFIXES, unknown: float = 8.0) -> DataFrame:
    """host, n, bad, alpha, beta: the beta posterior of each host's rate of bad pages.

    The prior of all pages shrinks the suffix, the suffix's posterior mean the registered domain, and the domain's
    the host.  How many pages each prior weighs as is estimated from the data, level by level: much where the parts of
    a whole hardly differ, little where they do; ``unknown`` where no two parts of one whole have outcomes.  ``outcomes``
    has page_id and bad (0 or 1); its nulls count for nothing, and so do pages without an outcome, but their hosts
    inherit from the levels above.  Without any outcome, an empty table too, all hosts have the same even prior."""
    known = outcomes.filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(known, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad"))
    hosts = kept(_levels(hosts, suffixes).select("host", "n", "bad", "suffix", "domain"))  # one row a host, read four times
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    levels = [_spread(df, above).select(F.lit(k).alias("k"), "num", "den") for k, (df, above) in enumerate([(tops, []), (domains, ["suffix"]), (hosts, ["suffix", "domain"])])]
    found = {r.k: r for r in levels[0].unionByName(levels[1]).unionByName(levels[2]).collect()}  # three rows
    s_top, s_domain, s_host = (F.lit(_strength(found[k].num, found[k].den, unknown)) for k in range(3))
    whole = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    prior = F.lit((whole.bad + 1.0) / (whole.n + 2.0))
    tops = tops.select(F.col("suffix").alias("_s"), ((F.col("bad") + s_top * prior) / (F.col("n") + s_top)).alias("sm"))
    domains = domains.join(tops, F.col("suffix") == F.col("_s")).select("_s", F.col("domain").alias("_d"), ((F.col("bad") + s_domain * F.col("sm")) / (F.col("n") + s_domain)).alias("dm"))
    out = hosts.join(domains, (F.col("suffix") == F.col("_s")) & (F.col("domain") == F.col("_d")))
    return out.select("host", "n", "bad", (F.col("bad") + s_host * F.col("dm")).alias("alpha"), (F.col("n") - F.col("bad") + s_host * (1 - F.col("dm"))).alias("beta"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, *, rules: list = RULES, suffixes: Sequence[str] = SUFFIXES, unknown: float = 8.0, max_bad: float = 0.3, tail: float = 0.05,
) -> DataFrame:
    """The columns of ``pages`` and host, path, rule, verdict.

    The longest fitting rule decides; else a host is blocked when the lower bound of its posterior rate of bad pages
    (the quantile ``tail`` of the beta distribution) and its mean are over ``max_bad``.  A null url, or one without
    "://", has an empty host and path and is judged by the pages like it.  Repeated rows get equal results; columns named
    as results are replaced; an empty table gives an empty result, and without outcomes only the rules block."""
    rep = host_reputation(pages, outcomes, suffixes=suffixes, unknown=unknown)
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    bad = F.when((mean > max_bad), beta_below(max_bad, F.col("alpha"), F.col("beta")) < tail).otherwise(F.lit(False))
    hosts = rep.select(F.col("host").alias("_host"), bad.alias("_bad"))
    judged = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = judged.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    # one row a host on this side; AQE cuts a host with a large part of the pages
    out = ruled.join(hosts, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("rule", F.col("_r.rule")).withColumn("verdict", verdict).drop("_r", "_host", "_bad")
