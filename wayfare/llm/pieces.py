"""SentencePiece encoding and decoding of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row.

    A null text is an empty one, whose only id is the end id.  Texts are coded row by row, so repeated rows get equal
    results and an empty table an empty result.  Only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the tokenizer's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        from wayfare.llm.bpe import codec

        coder = codec(shared.value)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column("text"):
                i = coder.codes(t.as_py())
                n.append(i.count(" ") + 1)
                ids.append(sha256(i.encode()).hexdigest())
                back.append(sha256(coder.decode_codes(i).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and ids (array), the end id last: the general form.

    A null text is an empty one, whose only id is the end id.  Texts are coded row by row and as a whole, however long;
    repeated rows get equal ids, an empty table gives an empty result.  Only doc_id and text are read, so other columns
    cannot clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from wayfare.llm.bpe import codec

        codes = codec(shared.value).codes
        for b in batches:
            for lo in range(0, b.num_rows, 500):  # ids take more room than texts
                part = b.slice(lo, 500)
                ids = [np.array(codes(t.as_py()).split(" "), np.int32) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def with_decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """The columns of rows with ids, and last the text of the ids; a text column is replaced.

    Null ids give an empty text, and so do ids of control pieces; repeated rows get equal texts; an empty table gives an
    empty result.  Other columns pass through whatever their names."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wayfare.llm.bpe import codec

        decode = codec(shared.value).decode_codes
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [decode(" ".join(map(str, x.as_py() or ()))) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(texts, pa.string())], [*others, "text"])

    kept = rows.select(*others)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("text", StringType())]))


def decode_ids(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with doc_id and ids, as ``with_decoded``; other columns are left out."""
    return with_decoded(rows.select("doc_id", "ids"), model).select("doc_id", "text")
