"""Hierarchies: closures of links from a class to itself."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Frame, Order, Val, fresh, scan, settled
from ..syntax import QueryError

#: Steps that the engine is told to allow: what ends a walk is the end of its chain, or a cycle, which is an error.
STEPS = 2**31 - 1


def _edges(c: Compiler, focus: Val, tree: object) -> DataFrame:
    """(src, dst) of the link over the whole class."""
    if not focus.cls or len(focus.ids) != 1:
        raise QueryError("a hierarchy needs entities with a simple key")
    base = scan(focus.cls, c.root)
    v = c.compile(tree, c.top.at(base.frame, base.val))
    val = v.val if isinstance(v, Flow) else v
    if not val.cls or val.cls is not focus.cls:
        raise QueryError(f"{tree} does not lead from {focus.cls.name} to {focus.cls.name}")
    if isinstance(v, Flow):
        v = settled(v)
        v.frame.reach(base.frame)
    df = (v.frame if isinstance(v, Flow) else base.frame).df
    return df.select(F.col(base.val.ids[0]).alias("src"), F.col(val.ids[0]).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def _walk(spark: SparkSession, tables: dict[str, DataFrame], starts: str, step: str) -> DataFrame:
    """A recursive query over some tables, without limits on rows and steps.

    Its joins are to be merges: tables that are broadcast go through the driver, and again in each step."""
    views = {n: fresh(n) for n in tables}
    for n, df in tables.items():
        df.createOrReplaceTempView(views[n])
    try:
        return spark.sql(f"WITH RECURSIVE walk(start, node, level, path) MAX RECURSION LEVEL {STEPS} AS ({starts.format(**views)} UNION ALL {step.format(**views)}) SELECT * FROM walk LIMIT ALL")
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def _closure(c: Compiler, s: Scope, tree: object) -> DataFrame:
    """(start, node, level, path) of all that the rows in focus lead to; one that leads to itself is an error."""
    own = s.frame.df.select(F.col(s.focus.ids[0]).alias("id")).filter("id IS NOT NULL").distinct()
    again = "IF(array_contains(path, dst) OR dst = start, raise_error(concat('a cycle at ', CAST(dst AS STRING))), dst)"
    return _walk(
        c.catalog.spark, {"edges": _edges(c, s.focus, tree), "own": own},
        "SELECT /*+ MERGE(e) */ src, IF(src = dst, raise_error(concat('a cycle at ', CAST(dst AS STRING))), dst), 1L, array(dst) FROM {own} JOIN {edges} e ON id = src",
        f"SELECT /*+ MERGE(e) */ start, {again}, level + 1, concat(path, array(dst)) FROM walk JOIN {{edges}} e ON node = src",
    )


@rule("connect", "and_connect")
def connect(c: Compiler, s: Scope, args: tuple, name: str) -> Flow:
    """All that the link leads to in one step or more (and_: the start too), each followed by what it leads to."""
    focus = s.focus
    df = _closure(c, s, args[0])
    if name == "and_connect":
        own = focus.cls.df.select(F.col(focus.cls.key[0]).alias("start"))
        df = df.unionByName(own.select("start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("level"), F.array().cast(df.schema["path"].dataType).alias("path")))
    names = {x: fresh("k") for x in ("start", "node", "path")}
    frame = Frame(df.select(*[F.col(x).alias(n) for x, n in names.items()]), s.frame, [(focus.ids[0], names["start"])], [names["start"], names["path"]], [Order(F.col(names["path"]))])
    return Flow(frame, Val("entity", cls=focus.cls, ids=(names["node"],), tag=focus.cls.name))


@rule("depth")
def depth(c: Compiler, s: Scope, args: tuple) -> Val:
    """How many steps the link leads at most."""
    df = _closure(c, s, args[0]).groupBy("start").agg(F.max("level").alias("level"))
    start, level = fresh("k"), fresh("c")
    frame = Frame(df.select(F.col("start").alias(start), F.col("level").alias(level)), s.frame, [(s.focus.ids[0], start)])
    return Val("int", F.coalesce(frame.aggregate(lambda k: F.max(level), ()), F.lit(0).cast("bigint")))


@rule("sort_connect")
def sort_connect(c: Compiler, s: Scope, args: tuple) -> Flow:
    """Values so that each follows all that its link leads to, as far as that is among them: what follows a value comes
    right after it, and siblings keep their order.  What lies on a cycle, or only after one, is left out."""
    q = settled(c.flow(args[0], s, "sort_connect"))
    if not q.val.cls or len(q.val.ids) != 1:
        raise QueryError("sort_connect needs entities with a simple key")
    v = c.compile(args[1], s.at(q.frame, q.val))
    if (v.val if isinstance(v, Flow) else v).cls is not q.val.cls:
        raise QueryError(f"{args[1]} does not lead to {q.val.cls.name}")
    if isinstance(v, Flow) or q.frame.own():
        return _sorted_groups(q, v)
    numbered, n = q.frame.numbered()
    rows = numbered.select(F.col(q.val.ids[0]).alias("id"), F.col(v.ids[0]).alias("parent"), F.col(n).alias("n"))
    known = rows.select(F.col("id").alias("known"))
    edges = rows.join(known.hint("merge"), F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("parent"), "n")
    walk = _walk(c.catalog.spark, {"edges": edges}, "SELECT id, id, 1L, array(n) FROM {edges} WHERE parent IS NULL", "SELECT /*+ MERGE(e) */ walk.start, e.id, level + 1, concat(path, array(e.n)) FROM walk JOIN {edges} e ON e.parent = walk.node")
    node, path = fresh("k"), fresh("path")
    df = q.frame.df.join(walk.select(F.col("node").alias(node), F.col("path").alias(path)).hint("merge"), F.col(q.val.ids[0]) == F.col(node)).drop(node)
    frame = q.frame.derive(df, order=[Order(F.col(path))])
    frame.explicit = True
    return Flow(frame, replace(q.val))


def _sorted_groups(q: Flow, v: Val | Flow) -> Flow:
    """For links with many targets, or below the top: the values under one row above are sorted by one task, which holds
    their keys and links only."""
    if isinstance(v, Flow):
        if v.span is not None or v.frame.up is not q.frame:
            raise QueryError("the link must start at the values")
        links = F.coalesce(v.frame.aggregate(lambda k: F.collect_list(F.when(k, F.col(v.val.ids[0])) if k is not None else F.col(v.val.ids[0])), v.cond), F.array())
    else:
        links = F.array_compact(F.array(F.col(v.ids[0])))
    f, own = q.frame, q.frame.own()
    marked, needs = fresh("n"), fresh("needs")
    numbered, n = f.derive(f.df.withColumn(needs, links)).numbered()
    numbered = numbered.withColumnRenamed(n, marked)
    keys = {b: fresh("key" if b.startswith("key_") else "k") for b in own}
    rows = numbered.select(*[F.col(b).alias(k) for b, k in keys.items()], F.col(marked).alias("n"), F.col(q.val.ids[0]).alias("id"), F.col(needs).alias("needs"))
    place, at = fresh("place"), fresh("n")
    schema = StructType([*[rows.schema[k] for k in keys.values()], StructField(at, LongType()), StructField(place, LongType())])

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", ignore_index=True)
        found = topological(list(group["id"]), [list(x) for x in group["needs"]])
        out = group.loc[found, list(keys.values())].reset_index(drop=True)
        return out.assign(**{at: group["n"].to_numpy()[found], place: range(len(found))})

    placed = rows.groupBy(*keys.values()).applyInPandas(ordered, schema)
    on = F.col(marked) == F.col(at)
    for b, k in keys.items():
        on = on & F.col(b).eqNullSafe(F.col(k))
    df = numbered.join(placed, on).drop(marked, needs, at, *keys.values())
    frame = f.derive(df, order=[Order(F.col(place))])
    frame.explicit = True
    return Flow(frame, replace(q.val))


def topological(ids: list, needs: list[list]) -> list[int]:
    """Places of values so that each comes after those whose ids it needs, if they are there at all."""
    places: dict = {}
    for i, x in enumerate(ids):
        places.setdefault(x, []).append(i)
    after: list[list[int]] = [[] for _ in ids]
    open_needs = [0] * len(ids)
    for i, wanted in enumerate(needs):
        for j in (j for x in wanted for j in places.get(x, ())):
            after[j].append(i)
            open_needs[i] += 1
    ready, out = [i for i in reversed(range(len(ids))) if not open_needs[i]], []
    while ready:
        i = ready.pop()
        out.append(i)
        freed = []
        for j in after[i]:
            open_needs[j] -= 1
            if not open_needs[j]:
                freed.append(j)
        ready += reversed(freed)
    return out
