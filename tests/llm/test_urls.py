"""Host reputation: levels, strengths, the posterior's tail, and hosts of the pages table that turn bad."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayfare.llm import urls


def below(x, a, b):
    """The integral of the beta density up to x, by the trapezoidal rule in t = sin(u)^2."""
    n, top = 20_000, math.asin(math.sqrt(x))
    f = lambda u: 2 * math.exp((2 * a - 1) * math.log(math.sin(u)) + (2 * b - 1) * math.log(math.cos(u)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return top / n * (sum(f(i * top / n) for i in range(1, n)) + f(top) / 2)


def test_tail_as_the_integral(spark):
    cases = [(x, a, b) for x in (0.1, 0.3, 0.5) for a, b in ((2.5, 1.5), (8.2, 3.1), (40.0, 55.0), (400.0, 500.0), (30_000.0, 45_000.0), (0.8, 0.4)) if a / (a + b) > x]
    df = spark.createDataFrame([(x, float(a), float(b)) for x, a, b in cases], "x double, a double, b double")
    for x in {c[0] for c in cases}:
        for r in df.filter(F.col("x") == x).withColumn("p", urls.beta_below(x, F.col("a"), F.col("b"))).collect():
            if r.a > 0.5:
                assert r.p == pytest.approx(below(x, r.a, r.b), abs=2e-4), r


def test_levels(spark):
    hosts = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "u:p@x.y.com.:80": ("com", "y.com"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
        "[::1]:80": ("[::1]", "[::1]"), "": ("", ""), "x.www.ck": ("ck", "www.ck"), "a.b.c.ck": ("c.ck", "b.c.ck"), "localhost": ("localhost", "localhost"), "p.github.io": ("github.io", "p.github.io"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.suffix, r.domain) for r in urls._levels(df, ["co.uk", "*.ck", "!www.ck", "github.io"]).collect()}
    assert got == hosts
    assert {r.suffix for r in urls._levels(df.filter("host = 'a.b.co.uk'"), []).collect()} == {"uk"}


def strength(children):
    """children: (parent, n, bad); the estimate in plain Python."""
    groups = defaultdict(list)
    for p, n, bad in children:
        if n:
            groups[p].append((n, bad))
    num = den = 0.0
    for g in groups.values():
        total = sum(n for n, _ in g)
        m = sum(b for _, b in g) / total
        num += sum(n * (b / n - m) ** 2 for n, b in g) - m * (1 - m) * (len(g) - 1)
        den += m * (1 - m) * (total - sum(n * n for n, _ in g) / total - (len(g) - 1))
    return 8.0 if den <= 1e-12 else urls.MOST if num / den <= 1 / (1 + urls.MOST) else max(urls.LEAST, den / num - 1)


def judged(pages, outcomes):
    """host -> blocked, in plain Python, for hosts with plain suffixes."""
    bad = {}
    for p, b in outcomes:
        bad[p] = max(b, bad.get(p, 0))
    hosts = defaultdict(lambda: [0, 0])
    for p, h in pages:
        hosts[h]  # noqa: B018
        if p in bad:
            hosts[h][0] += 1
            hosts[h][1] += bad[p]
    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    sums = defaultdict(lambda: [0, 0])
    for h, (n, b) in hosts.items():
        for k in (("d", domain(h)), ("s", suffix(h)), "all"):
            sums[k][0] += n
            sums[k][1] += b
    s_host = strength([(domain(h), n, b) for h, (n, b) in hosts.items()])
    s_domain = strength([(suffix(k[1]), *v) for k, v in sums.items() if k[0] == "d"])
    s_top = strength([("", *v) for k, v in sums.items() if k[0] == "s"])
    out, prior = {}, (sums["all"][1] + 1) / (sums["all"][0] + 2)
    for h, (n, b) in hosts.items():
        (sn, sb), (dn, db) = sums["s", suffix(h)], sums["d", domain(h)]
        dm = (db + s_domain * (sb + s_top * prior) / (sn + s_top)) / (dn + s_domain)
        x, y = b + s_host * dm, n - b + s_host * (1 - dm)
        out[h] = x / (x + y) > 0.3 and below(0.3, x, y) < 0.05
    return out


def test_hosts_of_the_pages_table(spark):
    d = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    # one host with many pages turns bad; a host without outcomes appears under its registered domain, and one under another
    turned = pages.withColumn("url", F.when(F.col("url").contains("//ththou.example.com"), F.regexp_replace("url", "ththou.example.com", "farm.bad-site.example")).otherwise(F.col("url")))
    extra = spark.createDataFrame([(10**9, "http://fresh.bad-site.example/x"), (10**9 + 1, "http://fresh.good-site.org/x")], "page_id long, url string")
    turned = turned.unionByName(extra)
    hosts = {r.page_id: r.host for r in turned.select("page_id", urls.host_of(F.col("url")).alias("host")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    outcomes = [(p, 1 if h == "farm.bad-site.example" else int(labels[p] == 0)) for p, h in hosts.items() if p in labels or h == "farm.bad-site.example"]
    got = urls.filter_urls(turned, spark.createDataFrame(outcomes, "page_id long, bad int")).filter("rule IS NULL").select("host", "verdict").distinct().collect()
    want = judged(hosts.items(), outcomes)
    assert {r.host: r.verdict == "block" for r in got} == {r.host: want[r.host] for r in got} and len(got) > 50
    assert want["farm.bad-site.example"] and want["fresh.bad-site.example"] and not want["fresh.good-site.org"]
    assert sum(want.values()) == 2  # clean hosts stay


def test_without_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.io/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()} == {"allow"}
