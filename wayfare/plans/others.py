"""Nested documents, functions from outside, host combinators, and groups by time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import combinators as q
from .. import documents as d
from ..query import execute, prepare
from ..streaming import sessions, windowed
from .store import store


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as nested documents: nations inside by name, customers inside these by number."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    customers = read("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal")))).alias("customers"))
    nations = read("nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), "customers"))).alias("nations"))
    return read("region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), "nations")


def document_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, nations, customers, balance = d.Fields("name", "nations", "customers", "acctbal")
    query = d.Select(name=name, n=d.Count(nations), m=d.Count(nations >> customers), top=d.Max(nations >> customers >> balance), rich=d.Count(nations >> customers >> d.Filter(balance > 9000)))
    return query(nested(spark, sf_dir)).select("value.*")


def document_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, nations, customers, balance = d.Fields("name", "nations", "customers", "acctbal")
    best = nations >> customers >> d.Filter(balance == d.Ref("top")) >> d.Field("id")
    query = d.Given(d.Select(name=name, best=d.First(best)), top=d.Max(nations >> customers >> balance))
    return query(nested(spark, sf_dir)).select("value.*")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.from_json("props", "k bigint"))
    query = d.Select(event=d.Field("event_id"), k=d.Field("props") >> d.Field("k"), odd=(d.Field("props") >> d.Field("k")) % 2 == 1)
    return query(events).select("value.*")


def host_combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, name, balance = q.Fields("order", "name", "acctbal")
    query = q.Field("customer") >> q.ThenFilter((balance > 5000) & q.Exists(order)) >> q.ThenSelect(name, ("orders", q.Count(order)), ("spent", q.SumOf(order >> "totalprice"))) >> q.ThenSort(q.Desc(q.Field("orders"))) >> q.ThenTake(50)
    return query.run(store(spark, sf_dir))


def udf_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def length(names: pd.Series) -> pd.Series:
        return names.str.len()

    words = lambda x: F.split(x, " ")
    query = q.Field("part") >> q.ThenSelect(q.Field("id"), ("length", q.Lift(length, "int", q.Field("name"))), ("words", q.Count(q.LiftMany(words, "str", q.Field("name")))))
    return query.run(store(spark, sf_dir))


def udaf_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = lambda x: F.max(x) - F.min(x)
    query = q.Field("nation") >> q.ThenSelect(q.Field("name"), ("spread", q.Aggregate(spread, "float", q.Field("customer") >> "acctbal", zero=0.0)), ("median", q.Aggregate(F.median, "float", q.Field("customer") >> "acctbal")))
    return query.run(store(spark, sf_dir))


def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = q.Field("part")
    query = part >> q.ThenFilter(q.Field("size") > 10) >> q.ThenSummarize(("n", q.Count(part)), ("dearest", q.MaxOf(part >> "retailprice")), ("mean", q.MeanOf(part >> "size")))
    return query.run(store(spark, sf_dir))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = windowed(events, "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "top": F.max("value")})
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "top")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sessions(events, "ts", "30 minutes", ["user_id"], {"n": F.count(F.lit(1))}).groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators over lists: each item beside a single value, or alone."""
    name, nations, customers, balance = d.Fields("name", "nations", "customers", "acctbal")
    all_of = nations >> customers >> balance
    query = d.Select(name=name, least=-d.Max(-all_of), twice=d.Max(all_of * 2), letters=d.Max(d.Len(nations >> d.Field("name"))), two=d.Count(d.First(all_of, 2)), over=d.Count((all_of > 9000) >> d.Filter(d.Here())))
    return query(nested(spark, sf_dir)).select("value.*")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query, parsed once, with two values of its parameter."""
    rich = prepare(store(spark, sf_dir), "customer:filter(acctbal > LEAST):group:select(least => LEAST, n => count(customer))", "LEAST")
    return rich(LEAST=1000).unionByName(rich(LEAST=9000))


def list_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that holds lists: its elements are values like others."""
    db = store(spark, sf_dir)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    words = read("part").select("p_partkey", F.split("p_name", " ").alias("words"))
    db.attach("label", words, "p_partkey")
    return execute(db, 'label:select(id, n => count(words), r => count(words:filter(startswith(here, "r"))), has => "red" in words)')


def lift_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function with many values, applied to many values; and a named, decorated query."""
    words = q.LiftMany(lambda x: F.split(x, " "), "str", q.Field("part") >> "name")
    query = q.Record(q.Decorate("n", q.Count(words)), q.Decorate("kinds", q.Count(q.Unique(words))), q.Decorate("none", q.Count(q.Empty)), q.Decorate("missing", q.Count(q.Null)))
    return query.run(store(spark, sf_dir))


def adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One, at most one and any number of values as asked for."""
    nation, customer = q.Field("nation"), q.Field("customer")
    one, some = q.ExpectOne(q.Field("region") >> "name"), q.ExpectAtMostOne(customer >> q.ThenTake(1))
    query = nation >> q.ThenSelect(q.Field("id"), ("region", one), ("first", some >> "id"), ("n", q.Count(q.ExpectAnything(customer))))
    return query.run(store(spark, sf_dir))


def flat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and records inside become columns."""
    return execute(store(spark, sf_dir), "customer:dataframe(id, nation:select(nation => name, region), top => record(balance => acctbal))")


def _text(query: str, dialect: str = "v1", **params: object):
    return lambda spark, sf_dir: execute(store(spark, sf_dir), query, dialect=dialect, **params)


TEXTS = {
    "nulls_last": _text("order:select(id, most => max(lineitem:filter(quantity > 48).quantity)):sort(most:desc:nulllast, id:desc):take(500)"),
    "nulls_first": _text("order:select(id, most => max(lineitem:filter(quantity > 48).quantity)):sort(most:nullfirst, id:desc):take(500)"),
    "quotient": _text("part:select(id, a => size ÷ 7, b => -size ÷ 7, c => null)"),
    "money": _text("part:select(id, third => size*_usd/3, twice => 2*(size*_usd), rate => size*_usd/(8*_usd))"),
    "v2_neighbours": _text("nation:select(id, n => count(before), total => sum(around(region).id))", "v2"),
    "v2_unique": _text("order.orderpriority:unique:take(3):select(first => here)", "v2"),
    "v2_group_empty": _text("customer:filter(id < 0):group:select(n => count(customer))", "v2"),
    "group_empty": _text("customer:filter(id < 0):group:select(n => count(customer))"),
    "cube_empty": _text("customer:filter(id < 0):group_cube(mktsegment, nation):select(mktsegment, nation => nation.id, n => count(customer), total => sum(customer.acctbal))"),
    "empty": _text("region:select(id, n => count([]), more => merge(nation.id, []):take(2))"),
}
QUERIES = {
    f.__name__: f
    for f in (document_select, document_given, document_lists, json_props, host_combinators, udf_lift, lift_many, udaf_custom, summarize, prepared, list_column, adapters, flat_table, event_windows, event_sessions)
} | TEXTS
_ALL = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_MOST = "SELECT o_orderkey AS id, max(l_quantity) FILTER (l_quantity > 48) AS most FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
SQL = {
    "document_lists": f"SELECT r_name AS name, min(c_acctbal) AS least, max(c_acctbal) * 2 AS twice, max(length(n_name)) AS letters, 2 AS two, count(*) FILTER (c_acctbal > 9000) AS over FROM {_ALL} GROUP BY r_name",
    "prepared": "SELECT least::BIGINT AS least, count(c_custkey) AS n FROM (SELECT unnest([1000, 9000]) AS least) LEFT JOIN customer ON c_acctbal > least GROUP BY least",
    "list_column": "SELECT p_partkey AS id, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'r'))) AS r, list_contains(w, 'red') AS has FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
    "lift_many": "SELECT count(*) AS n, count(DISTINCT w) AS kinds, 0::BIGINT AS none, 0::BIGINT AS missing FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)",
    "adapters": "SELECT n_nationkey::BIGINT AS id, r_name AS region, min(c_custkey) AS first, count(c_custkey) AS n FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
    "flat_table": "SELECT c_custkey AS id, n_name AS nation, r_name AS name, c_acctbal AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "nulls_last": f"{_MOST} ORDER BY most DESC NULLS LAST, id DESC LIMIT 500",
    "nulls_first": f"{_MOST} ORDER BY most ASC NULLS FIRST, id DESC LIMIT 500",
    "quotient": "SELECT p_partkey AS id, (p_size // 7)::BIGINT AS a, (-(p_size // 7))::BIGINT AS b, NULL::VARCHAR AS c FROM part",
    "money": "SELECT p_partkey AS id, round(p_size / 3, 2)::DECIMAL(18, 2) AS third, (2 * p_size)::DECIMAL(18, 2) AS twice, p_size / 8 AS rate FROM part",
    "v2_neighbours": "SELECT n_nationkey::BIGINT AS id, row_number() OVER (ORDER BY n_nationkey) AS n, (sum(n_nationkey) OVER (PARTITION BY n_regionkey))::BIGINT AS total FROM nation",
    "v2_unique": "SELECT o_orderpriority AS first FROM orders GROUP BY o_orderpriority ORDER BY min(o_orderkey) LIMIT 3",
    "v2_group_empty": "SELECT 0::BIGINT AS n WHERE false",
    "group_empty": "SELECT 0::BIGINT AS n",
    "cube_empty": "SELECT NULL::VARCHAR AS mktsegment, NULL::BIGINT AS nation, 0::BIGINT AS n, 0.0::DOUBLE AS total",
    "empty": "SELECT r_regionkey::BIGINT AS id, 0::BIGINT AS n, list(n_nationkey::BIGINT ORDER BY n_nationkey)[1:2] AS more FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey",
    "document_select": f"SELECT r_name AS name, count(DISTINCT n_nationkey) AS n, count(*) AS m, max(c_acctbal) AS top, count(*) FILTER (c_acctbal > 9000) AS rich FROM {_ALL} GROUP BY r_name",
    "document_given": f"SELECT r_name AS name, arg_max(c_custkey, c_acctbal) AS best FROM {_ALL} GROUP BY r_name",
    "json_props": "SELECT event_id AS event, (props->>'k')::BIGINT AS k, (props->>'k')::BIGINT % 2 = 1 AS odd FROM events",
    "host_combinators": "SELECT c_name AS name, count(*) AS orders, sum(o_totalprice) AS spent FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY c_custkey, c_name ORDER BY orders DESC, c_custkey LIMIT 50",
    "udf_lift": "SELECT p_partkey AS id, length(p_name) AS length, len(string_split(p_name, ' ')) AS words FROM part",
    "udaf_custom": "SELECT n_name AS name, coalesce(max(c_acctbal) - min(c_acctbal), 0) AS spread, median(c_acctbal) AS median FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    "summarize": "SELECT count(*) AS n, max(p_retailprice) AS dearest, avg(p_size) AS mean FROM part WHERE p_size > 10",
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL",
    "event_sessions": "SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY ALL",
}
