"""Very long texts, folders for what is written on the way, and sizes that follow the corpus."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wayfare.llm import chat, decontaminate, lines, near, quality, text


def test_many_lines_in_one_text(spark):
    menu = "\n".join(f"own {i}\nmenu" for i in range(30_000))
    rows = [(0, menu, "s0")] + [(i, "menu\nlast", f"s{i}") for i in range(1, 12)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].n_lines == 60_000 and got[0].n_removed == 29_999 and got[0].text.count("menu") == 1
    assert got[1].text == "last" and got[2].text == ""


def test_long_near_copies(spark):
    words = [f"w{i * 7919 % 50_021}" for i in range(40_000)]
    other = [*words[:20_000], "changed", *words[20_000:]]
    df = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(other)), (7, " ".join(reversed(words)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df).collect()}
    assert got == {5: (39_996, 5), 6: (39_997, 5), 7: (39_996, 7)}


def test_long_turns(spark):
    long = "x" * 2_000_000
    df = spark.createDataFrame([(1, 1, "user", long), (2, 1, "user", long), (2, 2, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert [(r.conv_id, r.n_turns, len(r.chat) > 2_000_000) for r in got] == [(2, 2, True)]


def test_items_of_a_shared_passage(spark):
    """Many documents with a passage of many items: each set of windows meets the items once."""
    passage = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([(i, f"{passage} tail{i} tail{i + 1}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {passage} after" if i % 3 else f"only {i}") for i in range(90)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, sorted(r["items"])) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {i: (12, list(range(40))) if i % 3 else (0, []) for i in range(90)}


def test_buckets_follow_the_corpus(spark):
    one = spark.createDataFrame([(1, "x" * 1000), (2, None)], "doc_id long, text string")
    assert quality.buckets_for(one) == quality.LEAST_BUCKETS == quality.buckets_for(one.limit(0))
    much = spark.range(40).select(F.lit("y" * 1_000_000).alias("text")).crossJoin(spark.range(50))
    assert quality.buckets_for(much) == 16_384  # a quarter of the root of 2e9 is 11,180
    docs = spark.createDataFrame([(1, "a b c"), (2, "a d")], "doc_id long, text string")
    assert quality.fit_weights(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), buckets=8192).count(",") == 8191


def test_a_cluster_has_to_name_the_folder():
    none = SimpleNamespace(isEmpty=lambda: True)
    scala = SimpleNamespace(getCheckpointDir=lambda: none)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: scala)), conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        text.shared_folder(spark)


def test_scratch_is_new_and_can_be_dropped(spark):
    a, b = text.scratch(spark, "x"), text.scratch(spark, "x")
    assert a != b and a.startswith(text.shared_folder(spark))
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3
    text.dropped(spark, a)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(a)
