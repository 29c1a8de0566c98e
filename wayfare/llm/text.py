"""Expressions on texts shared by the operators: all of them are built-in functions, run in the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased: ASCII without digits and letters.
MARKS = "".join(chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is never inlined again by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lowered(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are; a null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words between ASCII white space."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * len(SPACES[1:]))
    return F.array_remove(F.split(flat, " "), "")


def plain_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and anything beyond ASCII."""
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + MARKS, LOWER + " " * len(MARKS))
    return F.array_remove(F.split(flat, " "), "")


def windows(items: Column, width: int, of: Callable[[Column], Column]) -> Column:
    """``of(slice)`` for each run of ``width`` neighbours; none when there are fewer items."""
    return let(
        items,
        lambda a: F.when(
            F.size(a) >= width,
            F.transform(F.sequence(F.lit(1), F.size(a) - (width - 1)), lambda i: of(F.slice(a, i, F.lit(width)))),
        ),
    )


def shingles(words: Column, width: int = 5) -> Column:
    """64-bit hashes of the distinct word shingles; all the words as one when there are fewer; none without words."""
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < width, F.array(F.xxhash64(w)))
        .otherwise(F.array_distinct(windows(w, width, lambda s: F.xxhash64(s)))),
    )


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where it is unset, a local session gets a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="wayfare-")
        context.setCheckpointDir(named)
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends: results have to be written elsewhere by then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return f"{path}/data"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a written table in the shared folder: smaller than a checkpoint, and of a known size."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
