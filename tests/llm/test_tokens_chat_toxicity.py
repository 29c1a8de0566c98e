import random
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wayfare.llm import chat, pieces, tokens, toxicity
from wayfare.llm.bpe import MergeCodec
from wayfare.llm.queries import TOKENIZERS

from . import brute

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def fuzz(n, seed):
    rnd = random.Random(seed)
    alphabet = [*"abc  \n\t▁ж漢😀09.,:!?'\"<>|é\u0301\x00\u200b\ufeff\u3000", "the ", "ing", "  ", "\r\n", "</s>", "<s>", "<0x41>", "<unk>"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["a" * 3000, " " * 300, "ab" * 2000, "▁▁ ▁", "\n" * 400, "é" * 1500, "hello" * 1000]


def test_codec_as_the_library():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), MergeCodec(pieces.model_bytes(MODEL))
    for t in fuzz(3000, 1):
        ids = sp.encode(t, add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)
        assert codec.codes(t) == " ".join(map(str, ids)) and codec.decode_codes(codec.codes(t)) == sp.decode(ids)


def test_encoded_table(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x"), (7, None), (7, ""), (7, ""), (8, "long " * 50_000)], "doc_id long, text string"))
    want = []
    for d, t in docs.collect():
        ids = sp.encode(t or "", add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    model = pieces.model_bytes(MODEL)
    assert sorted(map(tuple, pieces.encode_digests(docs, model).collect()), key=str) == sorted(want, key=str)
    assert pieces.encode_digests(docs.limit(0), model).count() == 0
    few = docs.limit(20)
    back = pieces.decode_ids(pieces.encode_ids(few, model), model)
    assert sorted(map(tuple, back.collect())) == sorted((d, sp.decode(sp.encode(t or ""))) for d, t in few.collect())


def test_decoding_of_odd_ids(spark):
    sp, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.model_bytes(MODEL)
    ids = sp.encode("Some text, é漢😀 twice.")
    cases = [(1, ids), (1, ids), (2, []), (3, None), (None, [sp.eos_id()]), (4, [sp.bos_id(), *ids, sp.eos_id()]), (5, [sp.unk_id(), *ids]), (6, ids[1:])]
    rows = spark.createDataFrame([(*c, "old", [1]) for c in cases], "doc_id long, ids array<int>, text string, n array<int>")
    got = pieces.with_decoded(rows, model)
    assert got.columns == ["doc_id", "ids", "n", "text"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((d, sp.decode(x or [])) for d, x in cases), key=str)
    assert pieces.decode_ids(rows.limit(0), model).count() == 0


def test_flat_files_of_any_shape(spark, tmp_path):
    rnd, want = random.Random(5), {}
    for k in range(6):
        ids = [rnd.choice([1, 2, 513, 2, 1, 9]) for _ in range(rnd.randint(1, 400))] if k else [513, 513]
        np.array(ids, "<u2").tofile(tmp_path / f"f{k}")
        run, out = 0, []
        for i in ids:
            if i == 513:
                out.append((run, True))
                run = 0
            else:
                run += 1
        if run:
            out.append((run, False))
        want.update({(f"f{k}", p): x for p, x in enumerate(out)})
    (tmp_path / "empty").write_bytes(b"")
    for block in (2, 6, 64, 1 << 20):
        got = {(r.file.rsplit("/", 1)[1], r.place): (r.n_tokens, r.closed) for r in tokens.scan_flat(spark, str(tmp_path), eod=513, block_bytes=block).collect()}
        assert got == want


def test_ids_as_units():
    ids = [0, None, 5, -1, (1 << 63) - 1, -(1 << 63), 50256]
    for eod in (50256, 0, 16383, 16384):
        units = tokens.listed(ids, eod, "<u2")
        assert eod not in units and tokens.unlisted(units, eod) == ids
    assert tokens.unlisted(tokens.listed([], 1, "<u2"), 1) == []


def test_token_counts(spark, sf, tmp_path):
    from public_tokenizers import PATTERN

    ranks = pieces.model_bytes(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    odd = spark.createDataFrame([(None, "x"), (7, None), (7, ""), (8, "long " * 50_000), (8, "long")], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd).withColumn("file", F.lit("f"))
    encode = tokens._encoding(ranks, PATTERN).encode_ordinary
    want = sorted(((d, len(encode(t or ""))) for d, t in docs.select("doc_id", "text").collect()), key=str)
    for k, more in enumerate(({}, {"documents": 17, "block_bytes": 1000}, {"file_bytes": 5000, "documents": 40, "block_bytes": 500})):  # one document is far beyond a file, a file beyond a block
        got = tokens.count_tokens(docs, str(tmp_path / f"flat{k}"), ranks, PATTERN, eod=50256, **more)
        assert sorted(map(tuple, got.collect()), key=str) == want
    held = {r.file.rsplit("/", 1)[1]: r["count"] - 1 for r in tokens.scan_flat(spark, str(tmp_path / "flat2"), eod=50256).groupBy("file").count().collect()}
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "flat2").glob("part-*")}
    assert max(sizes.values()) > 50_000 and all(n == 1 or sizes[f] <= 5002 for f, n in held.items()) and max(held.values()) > 1
    assert tokens.count_tokens(docs.limit(0), str(tmp_path / "none"), ranks, PATTERN, eod=50256).count() == 0
    with pytest.raises(ValueError, match="a block"):
        tokens.count_tokens(docs, "p", ranks, PATTERN, eod=50256, block_bytes=1000)


def test_counts_do_not_depend_on_splits(spark, sf, tmp_path):
    from public_tokenizers import PATTERN

    ranks = pieces.model_bytes(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, tokens.count_tokens(docs, str(tmp_path / "a"), ranks, PATTERN, eod=50256).collect()))
    shuffled = docs.repartition(7, F.rand(1))  # gives other rows to other tasks each time it is read
    got = tokens.count_tokens(shuffled, str(tmp_path / "b"), ranks, PATTERN, eod=50256, documents=9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chats_as_brute_force(spark):
    rnd, rows = random.Random(3), []
    for c in range(120):
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t * 2, "user" if t % 2 == 0 else "assistant", rnd.choice(["hi", "yo"])))
    rows += [(None, 1, "user", "hi"), (500, None, "user", "hi"), (501, 1, None, None), (501, 1, None, None), (502, 3, "user", "b"), (502, 3, "user", "a"), (503, 0, "user", ""), (504, 0, "unknown", "")]
    convs = {}
    for c, t, r, x in sorted({(c, t, r or "unknown", x or "") for c, t, r, x in rows if c is not None and t is not None}):
        convs.setdefault(c, []).append((r, x))
    want = []
    for c, x in convs.items():
        same = [d for d, y in convs.items() if y == x]
        if c == min(same) and not any(len(y) > len(x) and y[: len(x)] == x for y in convs.values()):
            want.append((c, len(x), len(same), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in x)))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, chat string")
    assert sorted(map(tuple, chat.format_chats(df).collect())) == sorted(want)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_ordinal_fit_orders_grades():
    rnd, rows = random.Random(2), []
    for _ in range(600):
        g = rnd.randrange(3)
        rows.append((g, [0] * (g >= 1) + [1] * (g >= 2) + [2] * (rnd.random() < 0.5)))
    w, cuts = toxicity.fit_ordinal(rows, 3, 3, l2=1e-3)
    assert cuts[0] < cuts[1] and w[0] > 1 and w[1] > 1 and abs(w[2]) < 1
    # the gradient is that of the likelihood: no small step lowers the loss
    def loss(w, c):
        s, total = lambda z: 1 / (1 + np.exp(-z)), 0.0
        for g, x in rows:
            z = sum(w[i] for i in x)
            e = [1, *[s(z - k) for k in c], 0]
            total -= np.log(e[g] - e[g + 1])
        return total / len(rows) + 0.5e-3 * float(np.dot(w, w))
    best = loss(w, cuts)
    for i in range(3):
        for d in (-0.05, 0.05):
            assert loss(w + d * np.eye(3)[i], cuts) > best - 1e-5
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, cuts + d * np.eye(2)[i]) > best - 1e-5


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    grades = labels.select("doc_id", F.when(F.col("toxic") == 1, 2).otherwise(1 - F.col("quality")).alias("grade"))
    model = toxicity.fit_toxicity(docs, grades.filter("doc_id % 2 = 0"), n_grades=3, toxic_from=2)
    held = toxicity.score_toxicity(docs, model, toxic_from=2).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    bad, good = [r for r in held if r.truth == 1], [r for r in held if r.truth == 0]
    assert len(bad) > 100 and sum(r.toxic for r in bad) >= 0.9 * len(bad)  # some are labelled so without a toxic word
    assert sum(r.toxic for r in good) <= 0.01 * len(good)
    assert sum(r.severity for r in bad) / len(bad) > 1.5 > 0.5 > sum(r.severity for r in good) / len(good)


def test_scores_as_brute_force(spark):
    """severity and grade of whole texts from the model's weights, with features taken by other means."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    grades = labels.select("doc_id", F.when(F.col("toxic") == 1, 2).otherwise(1 - F.col("quality")).alias("grade"))
    model = toxicity.fit_toxicity(docs, grades, n_grades=3, toxic_from=2)
    odd = [(None, "x"), (-1, None), (-2, ""), (-3, "very " * 60_000 + "long"), (-4, " ".join(w.rstrip("$+") for w in model.weights) * 3)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = []
    for i, text in [tuple(r) for r in docs.collect()]:
        words = brute.PLAIN_WORD.findall((text or "").translate(brute.LOWER))
        z = 0.0
        for feature, weight in sorted(model.weights.items()):
            name, twice = feature.rstrip("+"), feature.endswith("+")
            n = sum((w == name[:-1]) if name.endswith("$") else w.startswith(name) for w in words) if name[: 1 + len(name) // 2].rstrip("$") in (text or "").translate(brute.LOWER) else 0
            z += weight * ((n >= 2 and 100 * n >= len(words)) if twice else n >= 1)
        over = [1 / (1 + np.exp(min(700.0, c - z))) for c in model.cuts]
        want.append((i, sum(over), sum(p >= 0.5 for p in over)))
    got = sorted(((r.doc_id, r.severity, r.grade, r.toxic) for r in toxicity.score_toxicity(docs, model, toxic_from=2).collect()), key=lambda r: (str(r[0]), r[1]))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    assert len(got) == len(want) and len(model.weights) > 3
    for (i, s, g, t), (j, x, y) in zip(got, want, strict=True):
        assert i == j and s == pytest.approx(x, abs=2e-6) and g == y and t == (y >= 2)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "you idiot", 2), (3, "you idiot", 2), (None, "hello", 2)], "doc_id long, text string, grade int")
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, grade int"), n_grades=3)
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == 5 and not any(r.toxic for r in got)
    grades = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (None, 1), (2, None), (9, 7)], "doc_id long, grade int")
    model = toxicity.fit_toxicity(docs, grades, n_grades=3, toxic_from=2, min_docs=1, min_gain=1.0)
    assert {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.severity > 1} == {3}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
