"""Quality rules, decontamination, line dedup, URL filters."""

import math
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, lines, quality, queries, urls

from . import brute

ODD = ["", None, " \n\t", "a", "# * $ % & | < >\n\n# *", "x\ny\nx\n \nx", "w " * 40, " ".join(f"w{i}" for i in range(30)), "A B c d e f g h A b c d e f g h", "é漢 \u00a0 z", "k " * 30_000]


def hashes(text):
    h = [xxhash.xxh64(w.translate(brute.LOWER).encode(), seed=42).intdigest() for w in brute.SPACE_WORD.findall(text or "")]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    pair = lambda a, b: xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=xxhash.xxh64(a.to_bytes(8, "little", signed=True), seed=42).intdigest()).intdigest()
    both = [pair(a, b) for a, b in zip(signed, signed[1:])]
    return [(x - (1 << 64) if x >> 63 else x) % 4096 for x in h + both]


def test_quality_rules_as_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"good plain words {i} " * 3 + " ".join(f"p{i}q{j}" for j in range(20))) for i in range(20)] + [(None, "zz"), (3, "zz"), (3, "zz")]
    labels = [(100 + i, 1 if i < 10 else 0) for i in range(20)] + [(None, 1), (101, None), (0, 1)]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, n_words int, kept string")
    got = quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr").collect()
    raw, target = Counter(), Counter()
    trusted = {d for d, q in labels if q == 1 and d is not None}
    for d, t in rows:
        raw.update(hashes(t))
        if d in trusted:
            target.update(hashes(t))
    n_raw, n_target = sum(raw.values()) + 4096, sum(target.values()) + 4096
    weight = [round((1 << 20) * (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw))) for b in range(4096)]
    want = []
    for d, t in rows:
        base, h = brute.quality_base(t), hashes(t)
        llr = int(math.trunc(sum(weight[b] for b in h) / len(h))) if h else 0
        want.append((d, *base, not base[-1] and llr >= round(quality.THRESHOLD * (1 << 20)), llr))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality.quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality_threshold_from_trusted_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").collect()
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    least = min(r.llr for r in got if r.doc_id in good and not r.base_failed)
    assert least > round(quality.THRESHOLD * quality.UNIT)
    assert all(r.kept == (not r.base_failed and r.llr >= least) for r in got)
    assert any(not r.base_failed and round(quality.THRESHOLD * quality.UNIT) <= r.llr < least for r in got)  # kept before
    few = docs.filter("doc_id < 60").select("doc_id", "text")
    both = [sorted(map(tuple, quality.quality_rules(few, labels.limit(0), **more).collect()), key=str) for more in ({}, {"threshold": None})]
    assert both[0] == both[1] and len(both[0]) == few.count()


def test_decontaminate_as_brute_force(spark):
    items = [(1, "One two three four five six seven eight nine"), (2, "short item"), (3, None), (4, "..."), (5, "two three four five six seven eight nine ten"), (None, "x y"), (2, "short item")]
    texts = [*ODD, "zero ONE,two three four five six seven eight nine ten eleven", "a short-item and short item", "one two three four five six seven", "short item two three four five six seven eight nine"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (2, texts[-1]), (2, texts[-1])]
    docs, bench = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, items int"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute.decontaminated(t, items)) for d, t in rows), key=str)
    for most in (decontaminate.BROADCAST_BYTES, 0):  # both ways to join
        got = decontaminate.decontaminate(docs, bench, broadcast_bytes=most)
        got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), decontaminate.digest(F.col("items")), "contaminated").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_lines_as_brute_force(spark):
    rows = [(i, f"menu \nown line {i}\n\nfooter {i % 2}\nmenu", f"s{i % 13}") for i in range(40)] + [(100, "menu", None), (101, None, "s1"), (102, "", "s1"), (None, "menu\nx", "s2"), (7, "menu\nfooter 1", "s3"), (7, "menu\nfooter 1", "s3")]
    rows += [(200 + i, f"near {i % 3}", f"t{i}") for i in range(9 * 3)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, h int, pos int")
    for sites in (3, 9, 10):
        seen, first = defaultdict(set), {}
        for d, t, s in rows:
            for p, x in enumerate((t or "").split("\n")):
                if x.strip():
                    seen[x.strip()].add(s)
                    at = (-1 if d is None else d, p)
                    first[x.strip()] = min(first.get(x.strip(), at), at)
        want = []
        for d, t, s in rows:
            if t is None:
                want.append((d, None, 0, 0))
                continue
            parts = list(enumerate(t.split("\n")))
            stay = [x for p, x in parts if not x.strip() or len(seen[x.strip()] - {None}) < sites or first[x.strip()] == (-1 if d is None else d, p)]
            want.append((d, "\n".join(stay), sum(bool(x.strip()) for _, x in parts), len(parts) - len(stay)))
        got = lines.dedup_lines(df, min_sites=sites)
        assert got.columns == ["doc_id", "text", "source", "h", "pos", "n_lines", "n_removed"]
        assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == sorted(want, key=str)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_url_filters(spark):
    pages = [(1, "http://A.Example.COM/en/7x?q"), (2, "https://example.com/en/8#y"), (3, "x://net/de/"), (4, "http://notexample.net/de/8"), (5, "http://b.example.net/de/8/"), (6, None), (7, "no scheme/en/"), (8, "http://"), (9, "http://a.org?x=/es/")]
    pages += [(100 + i, f"http://bad.site.uk/{i}") for i in range(60)] + [(200 + i, f"http://new{i}.site.uk/") for i in range(3)] + [(300 + i, f"http://fine.io/{i}") for i in range(60)] + [(None, "http://fine.io/"), (1, "http://fine.io/")]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(300 + i, 0) for i in range(60)] + [(None, 1), (301, None)], "page_id long, bad int")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, outcomes).collect()}
    assert got[pages[0][1]] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[pages[1][1]] == ("example.com", "/en/8", "com/en/", "block")
    assert got[pages[2][1]] == ("net", "/de/", "net/de/", "allow")
    assert got[pages[3][1]] == ("notexample.net", "/de/8", "net/de/", "allow")
    assert got[pages[4][1]] == ("b.example.net", "/de/8/", "example.net/de/8", "block")
    assert got[None][:3] == ("", "", None) and got["no scheme/en/"][:3] == ("", "", None) and got["http://"][:3] == ("", "", None)
    assert got[pages[8][1]][:3] == ("a.org", "", None)
    assert {got[f"http://bad.site.uk/{i}"][3] for i in range(60)} == {"block"}
    assert {got[f"http://new{i}.site.uk/"][3] for i in range(3)} == {"block"}  # from the registered domain
    assert got["http://fine.io/"][3] == "allow"
    assert urls.filter_urls(df.limit(0), outcomes).count() == 0
    assert len(urls.filter_urls(df, outcomes).collect()) == len(pages)
