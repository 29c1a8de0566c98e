"""Token counts from flat token files: a vectorised scan for separators, stitched over blocks by a prefix scan."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes in a file (but that a longer document has a file of its own), documents in it, and bytes in a block, at most.
FILE_BYTES, FILE_DOCUMENTS, BLOCK_BYTES = 16 << 20, 65_536, 1 << 20
#: Units that a document's id takes in a file's first record, and bits in a unit.
ID_UNITS, ID_BITS = 5, 14


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def separator_text(eod: int, dtype: str) -> str:
    """The identifier's bytes as a string of as many characters up to U+00FF."""
    return np.array([eod], dtype).tobytes().decode("latin-1")


def _shift(eod: int) -> int:
    """What is added to units of 14 bits so that none of them is the end-of-document id."""
    return 1 << ID_BITS if eod < 1 << ID_BITS else 0


def listed(ids: list[int | None], eod: int, dtype: str) -> np.ndarray:
    """The ids of a file's documents as units: 64 bits and one that says null."""
    whole = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    parts = [(whole >> np.uint64(ID_BITS * k)) & np.uint64((1 << ID_BITS) - 1) for k in range(ID_UNITS)]
    parts[-1] = parts[-1] | (np.array([i is None for i in ids], np.uint64) << np.uint64(ID_BITS - 1))
    return (np.stack(parts, axis=1).reshape(-1) + np.uint64(_shift(eod))).astype(dtype)


def unlisted(units: np.ndarray, eod: int) -> list[int | None]:
    """The ids that such units say."""
    parts = (units.astype(np.uint64) - np.uint64(_shift(eod))).reshape(-1, ID_UNITS)
    null = (parts[:, -1] >> np.uint64(ID_BITS - 1)).astype(bool)
    whole = np.zeros(len(parts), np.uint64)
    for k in range(ID_UNITS):
        whole |= (parts[:, k] & np.uint64((1 << ID_BITS) - 1)) << np.uint64(ID_BITS * k)
    return [None if none else i for i, none in zip(whole.view(np.int64).tolist(), null.tolist(), strict=True)]


def write_flat(docs: DataFrame, path: str, ranks: bytes, pattern: str, *, eod: int, dtype: str = "<u2", file_bytes: int = FILE_BYTES, documents: int = FILE_DOCUMENTS) -> None:
    """Writes flat files of token ids under ``path``: in each first a record of its documents' ids, then the tokens of
    one document after the other, each record with ``eod`` at its end.

    Ids and tokens are thus written by one pass, whatever the splits of the input.  Spark's own text writer and committer
    write the files, with the identifier's bytes as the line separator, so lost tasks are run again and leave nothing
    behind.  A null text is an empty one.  A task holds one file at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # of the tokenizer's size
    end = np.array([eod], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            value = end.join([listed(ids, eod, dtype).tobytes(), *parts])
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                one = np.array(encode(text.as_py() or ""), dtype).tobytes()
                more = len(one) + (ID_UNITS + 1) * len(end)
                if ids and (size + more > file_bytes or len(ids) >= documents):
                    yield file()
                    size = 0
                ids.append(i)
                parts.append(one)
                size += more
        if ids:
            yield file()

    flat = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    flat.write.option("lineSep", separator_text(eod, dtype)).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def scan_flat(spark: SparkSession, path: str, *, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES, heads: bool = False) -> DataFrame:
    """(file, place, n_tokens, closed): the documents in flat token files, by their places from 0 on.

    n_tokens leaves the separator out.  What follows the last separator of a file is a document that is not closed; a
    file that ends with a separator has none, and an empty file has no documents.  A document never crosses files.  A
    file is read as a whole, so it may take 2 GB at most; it is searched block by block.  With ``heads`` the first
    record of each file is read as ids, and given as an array beside place 0."""
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, last, lengths, head = [], [], [], []
            for k, x in zip(b.column("block").to_pylist(), b.column("bytes"), strict=True):
                ids = np.frombuffer(x.as_buffer(), dtype)
                at = np.flatnonzero(ids == eod)
                n.append(len(ids))
                last.append(int(at[-1]) if len(at) else None)
                lengths.append(np.diff(at, prepend=-1) - 1)
                head.append(unlisted(ids[: at[0]], eod) if heads and k == 0 else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64())), pa.array(head, pa.list_(pa.int64()))],
                ["file", "block", "n", "last", "lengths", "head"],
            )

    step = block_bytes // size * size
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("file"), "length", "content")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"int((length - 1) div {step})")), lambda i: F.substring(F.col("content"), i * step + 1, F.lit(step)))
    blocks = files.select("file", F.posexplode(cut).alias("block", "bytes")).mapInArrow(run, "file string, block int, n bigint, last bigint, lengths array<bigint>, head array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))
    placed = blocks.withColumn("start", start).withColumn("places", F.coalesce(F.sum(F.size("lengths")).over(before), F.lit(0).cast("bigint")))
    placed = placed.withColumn("carry", F.col("start") - 1 - F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1).cast("bigint")))
    placed = placed.withColumn("end", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1)
    stitched = F.transform(F.col("lengths"), lambda x, i: F.struct((x + F.when(i == 0, F.col("carry")).otherwise(0)).alias("n"), F.lit(True).alias("closed")))
    open_n = F.when(F.col("last").isNull(), F.col("carry") + F.col("n")).otherwise(F.col("n") - 1 - F.col("last"))
    rest = F.when(F.col("end") & (open_n > 0), F.array(F.struct(open_n.alias("n"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<n:bigint,closed:boolean>>"))
    out = placed.select("file", "places", "head", F.posexplode(F.concat(stitched, rest)).alias("i", "x"))
    place = F.col("places") + F.col("i")
    return out.select("file", place.alias("place"), F.col("x.n").alias("n_tokens"), F.col("x.closed").alias("closed"), *([F.when(place == 0, F.col("head")).alias("head")] if heads else []))


def count_tokens(
    docs: DataFrame, path: str, ranks: bytes, pattern: str, *, eod: int, dtype: str = "<u2", file_bytes: int = FILE_BYTES, documents: int = FILE_DOCUMENTS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_tokens) of ``docs``, counted in the flat files that it writes under ``path``.

    One row for each row; repeated rows get equal counts, a null or empty text 0; an empty table gives no rows.  Only
    doc_id (a whole number or null) and text are read, so other columns cannot clash.  A file's list of ids has to fit
    into its first block."""
    if block_bytes < np.dtype(dtype).itemsize * (ID_UNITS * documents + 1):
        raise ValueError("a block must hold the ids of a file's documents")
    write_flat(docs, path, ranks, pattern, eod=eod, dtype=dtype, file_bytes=file_bytes, documents=documents)
    found = scan_flat(docs.sparkSession, path, eod=eod, dtype=dtype, block_bytes=block_bytes, heads=True)
    # a file's blocks are together already, and its documents are bounded
    files = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "n_tokens"))).alias("x"), F.first("head", ignorenulls=True).alias("head"))
    whole = F.when(F.size("x") == F.size("head") + 1, F.slice("x", 2, F.size("head"))).otherwise(F.raise_error(F.concat(F.lit("ids and documents differ in "), "file")).cast("array<struct<place:bigint,n_tokens:bigint>>"))
    both = files.select(F.explode(F.zip_with("head", whole, lambda i, x: F.struct(i.alias("doc_id"), x["n_tokens"].alias("n_tokens")))).alias("r"))
    return both.select("r.doc_id", "r.n_tokens")
