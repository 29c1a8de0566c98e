"""Registered queries against DuckDB on the smallest tables, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wayfare import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def simple(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.5g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_as_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = [tuple(simple(r[c]) for c in cols) for r in got.collect()]
    cur = duck.execute(plans.SQL[name])
    there = [x[0] for x in cur.description]
    assert sorted(there) == cols
    at = [there.index(c) for c in cols]
    want = sorted((tuple(simple(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert sorted(rows, key=str) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_closure_below_every_part(spark, sf):
    got = {r.id: r.n for r in plans.QUERIES["connect_down"](spark, sf).collect()}
    ids = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    below = dict.fromkeys(ids, 0)
    for i in ids:
        while i > 0:
            i //= 2
            if i in below:
                below[i] += 1
    assert got == below and sum(n > 0 for n in got.values()) > 1
