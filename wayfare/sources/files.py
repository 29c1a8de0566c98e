"""CSV, JSON and Parquet files as classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..catalog import Catalog, Class


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, header: bool = True, sep: str = ",", money: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file of known columns; ``money`` names columns of amounts such as "$1,234.50"."""
    df = spark.read.csv(path, schema=schema, header=header, sep=sep)
    from pyspark.sql import functions as F

    for c in money:
        df = df.withColumn(c, F.regexp_replace(c, "[$,]", "").cast("decimal(18,2)"))
    return df


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, *, lines: bool = False) -> DataFrame:
    """A file that is one JSON value, or one value a line."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def attach_csv(db: Catalog, name: str, path: str, schema: str | T.StructType, key: str, **options) -> Class:
    reading = {k: options.pop(k) for k in ("header", "sep", "money") if k in options}
    return db.attach(name, lambda: read_csv(db.spark, path, schema, **reading), key, attributes=options.pop("attributes", None), **options)


def attach_parquet(db: Catalog, name: str, path: str, key: str | tuple[str, ...], **options) -> Class:
    return db.attach(name, lambda: db.spark.read.parquet(path), key, **options)
