"""Chat formatting: logged conversations that another one continues are dropped, the rest are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import kept

# fixed values: what stands around a turn
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text: distinct turns in order."""
    real = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return real.distinct().withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one continues; of equal ones the least conv_id.

    One conversation is one partition of a window, which spills: what a task holds is one turn at a time.

    A prefix's hash is the exclusive or of 128-bit hashes of its turns with their positions, so it rolls: each turn
    adds one term."""
    turns = _turns(rows)
    rolling = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = turns.select(
        "conv_id", "pos", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"),
        *[F.bit_xor(F.xxhash64(F.lit(k), "pos", "role", "text")).over(rolling).alias(f"h{k}") for k in (1, 2)],
    )
    hashed = kept(hashed)
    whole = hashed.filter("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = hashed.filter("pos < n").select(F.col("pos").cast("bigint").alias("n"), "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: one row for each maximal conversation.

    Turns are ordered by turn, then role and text; repeated rows count once.  A conversation is dropped if its turns
    (role and text) begin a longer one's; of equal ones the least conv_id stays, with their number as n_copies.  A
    null role reads "unknown", a null text is empty; rows without a conv_id or turn belong to no conversation.  An
    empty table gives an empty result; only conv_id, turn, role and text are read, so other columns cannot clash.  A
    rendered conversation is one string, so its turns together may take 2 GB at most."""
    best = maximal(rows).withColumnRenamed("conv_id", "_c")
    turns = _turns(rows).join(best, F.col("conv_id") == F.col("_c"))
    said = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE)).alias("said")
    chats = turns.select("conv_id", "n_turns", "n_copies", F.struct("pos", said).alias("x")).groupBy("conv_id", "n_turns", "n_copies").agg(F.collect_list("x").alias("x"))
    return chats.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform(F.array_sort("x"), lambda s: s["said"]), "").alias("chat"))
