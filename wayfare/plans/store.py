"""The catalog of the sales tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog


@functools.lru_cache(maxsize=64)
def table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, whose files and schema are looked up once in a session; its rows are read by each query."""
    return spark.read.parquet(path)


def store(spark: SparkSession, sf_dir: str) -> Catalog:
    """Classes of the tables under a folder; each is read when a query first names it, and only what is used of it."""
    db = Catalog(spark)
    read = lambda name: lambda: table(spark, f"{sf_dir}/{name}.parquet")
    plain = lambda prefix, names: {n: f"{prefix}_{n}" for n in names.split()}
    db.attach("region", read("region"), "r_regionkey", attributes=plain("r", "name"))
    db.attach("nation", read("nation"), "n_nationkey", attributes=plain("n", "name"))
    db.attach("customer", read("customer"), "c_custkey", attributes=plain("c", "name acctbal mktsegment"))
    db.attach("supplier", read("supplier"), "s_suppkey", attributes=plain("s", "name acctbal"))
    db.attach("part", read("part"), "p_partkey", attributes={**plain("p", "name brand size retailprice"), "type_": "p_type"})
    db.attach("order", read("orders"), "o_orderkey", attributes=plain("o", "orderstatus totalprice orderdate orderpriority"))
    lines = ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")
    db.attach("lineitem", read("lineitem"), tuple(f"l_{x}" for x in lines), attributes=plain("l", "linenumber quantity extendedprice discount tax returnflag linestatus shipdate"))
    db.attach("event", read("events"), "event_id", attributes={x: x for x in ("ts", "user_id", "event_type", "value", "props")})
    for source, name, target, column, key, inverse in (
        ("nation", "region", "region", "n_regionkey", "r_regionkey", "nation"),
        ("customer", "nation", "nation", "c_nationkey", "n_nationkey", "customer"),
        ("supplier", "nation", "nation", "s_nationkey", "n_nationkey", "supplier"),
        ("order", "customer", "customer", "o_custkey", "c_custkey", "order"),
        ("lineitem", "order", "order", "l_orderkey", "o_orderkey", "lineitem"),
        ("lineitem", "part", "part", "l_partkey", "p_partkey", "lineitem"),
        ("lineitem", "supplier", "supplier", "l_suppkey", "s_suppkey", "lineitem"),
    ):
        db.link(source, name, target, {column: key}, inverse=inverse)
    return db
