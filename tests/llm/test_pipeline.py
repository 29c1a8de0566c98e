"""Each stage against brute force on its own input, and the whole."""

from collections import defaultdict

import corpus_pipeline as cp
import sentencepiece

from wayfare.llm.queries import TOKENIZERS

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def check_lines(before, after):
    seen, first = defaultdict(set), {}
    for d, t, _, s, _ in before:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip():
                seen[x.strip()].add(s)
                first[x.strip()] = min(first.get(x.strip(), (d, p)), (d, p))
    want = []
    for d, t, lang, s, n in before:
        parts = list(enumerate((t or "").split("\n")))
        stay = [x for p, x in parts if not x.strip() or len(seen[x.strip()] - {None}) < 10 or first[x.strip()] == (d, p)]
        gone = len(parts) - len(stay)
        if not gone:
            want.append((d, t, lang, s, n))
        elif any(x.strip() for x in stay):
            want.append((d, "\n".join(stay), lang, s, len("\n".join(stay))))
    assert after == sorted(want, key=str)


def check_near(before, after):
    comp = brute.near_components([(r[0], r[1]) for r in before], 80)
    assert after == sorted((r for r in before if comp[r[0]][1] == r[0]), key=str)


def test_stages_as_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before, counts = rows(docs), [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "sentencepiece":
            sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
            want = sorted((r[0], sp.encode(r[1] or "", add_eos=True)) for r in before)
            assert sorted((r.doc_id, r.ids) for r in docs.collect()) == want and all(r.n_tokens == len(r.ids) for r in docs.collect())
            break
        assert docs.columns == COLUMNS
        after = rows(docs)
        if name == "quality rules":  # the verdict itself is tested with the operator
            assert set(after) <= set(before) and not any(brute.quality_base(r[1])[-1] for r in after)
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
            assert {r[0] for r in before if r[0] in good and not brute.quality_base(r[1])[-1]} <= {r[0] for r in after}
        elif name == "line dedup":
            check_lines(before, after)
        elif name == "near duplicates":
            check_near(before, after)
        elif name == "decontamination":
            assert after == sorted((r for r in before if not brute.decontaminated(r[1], items)[2]), key=str)
            assert len(after) < len(before)
        before = after
        counts.append(len(after))
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100


def test_odd_rows(spark, sf):
    good = " ".join(f"word{i}" for i in range(30))
    odd = spark.createDataFrame(
        [(None, good, "en", None, None, 1), (None, good, "en", None, None, 1), (1, None, None, "s", 0, 1), (2, "", "en", "s", 0, 1), (3, good, "en", "s", 5, 1), (3, good, "en", "s", 5, 1), (3, good + " x", "en", "s", 5, 1), (4, "z " * 40_000, "en", "s", 5, 1)],
        "doc_id long, text string, lang string, source string, n_chars long, key int",
    )
    want = {"quality rules": None, "line dedup": 8, "near duplicates": 6, "decontamination": 8, "sentencepiece": 8}
    for name, stage in cp.STAGES:
        got = stage(spark, odd, sf)
        assert got.columns == (odd.columns if name != "sentencepiece" else ["doc_id", "n_tokens", "ids"])
        n = got.count()
        assert want[name] is None or n == want[name], name
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 20 and len(cp.STAGES) == 5


def test_run_decodes_its_ids(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "text"]
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = got.collect()
    assert len(rows) > 20 and all(r.text == sp.decode(r.ids) for r in rows)
