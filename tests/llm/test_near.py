import random

from wayfare.llm import near

from . import brute

WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "ar", "en")]


def family(rnd, start, size, changes, length=60):
    base = [rnd.choice(WORDS) for _ in range(length)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, changes)):
            w[rnd.randrange(length)] = rnd.choice(WORDS)
        out.append((start + i, " ".join(w).capitalize()))
    return out


def run(spark, rows, percent):
    df = spark.createDataFrame([(d, t, "x", None) for d, t in rows], "doc_id long, text string, node string, n int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, percent=percent).collect()}


def test_radius_covers_the_threshold():
    assert near.radius(64, 85) >= 18 and near.radius(64, 80) > near.radius(64, 85)
    s = near.Scheme(64, 85)
    assert len(s.starts) * 2 > s.radius and s.sizes.min() >= 3


def test_families_as_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [r for k, n in enumerate((2, 3, 40, 90, 5)) for r in family(rnd, 1000 * k, n, 5)] + family(rnd, 9000, 1, 0) * 1
    rows += [(9100, rows[0][1]), (9101, rows[0][1].upper()), (9102, ""), (9103, None), (9104, " \n"), (9105, "one two"), (9106, "One  two"), (9107, "one two three")]
    rnd.shuffle(rows)
    for percent in (80, 85):
        assert run(spark, rows, percent) == brute.near_components(rows, percent)
    monkeypatch.setattr(near, "BLOCK_ROWS", 7)  # several blocks a bucket
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 600)
    assert run(spark, rows, 85) == brute.near_components(rows, 85)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows, 85) == brute.near_components(rows, 85)


def test_null_ids_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (2, "q w e r t y"), (5, "A b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 2, None, True)] * 2 + [(2, 2, 2, True)] * 3 + [(5, 2, 2, False)], key=str)
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_result_computes_no_graph(spark, sf):
    """The driver holds all plans and shuffles of a query at once: the components are made by queries of their own."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df, most in ((near.near_duplicates(docs), 6), (cp.near_stage(spark, docs, sf), 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and plan.count("Exchange ") <= most
