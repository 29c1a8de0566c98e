"""Aggregates over flows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Val, both
from ..operators.windows import over, running
from ..syntax import Call, QueryError


@dataclass(frozen=True)
class Aggregate:
    """make: the column of an aggregate over a column that is null where a row does not count; zero: for no rows."""

    make: Callable[[Column], Column]
    zero: object = None
    kind: str | None = None  # of the result, else the argument's
    takes: tuple[str, ...] = ()


AGGREGATES: dict[str, Aggregate] = {
    "count": Aggregate(F.count, 0, "int"),
    "exists": Aggregate(F.count, None, "bool"),
    "sum": Aggregate(F.sum, 0, None, ("int", "float", "money")),
    "max": Aggregate(F.max, None, None, ("int", "float", "money", "date", "time", "str")),
    "min": Aggregate(F.min, None, None, ("int", "float", "money", "date", "time", "str")),
    "mean": Aggregate(F.avg, None, "float", ("int", "float", "money")),
    "any": Aggregate(F.bool_or, False, "bool", ("bool",)),
    "all": Aggregate(F.bool_and, True, "bool", ("bool",)),
}


def define_aggregate(name: str, make: Callable[[Column], Column], *, kind: str | None = None, zero: object = None) -> None:
    """Adds an aggregate under a name: any function from a column to an aggregate, a grouped pandas UDF too."""
    AGGREGATES[name] = Aggregate(make, zero, kind)
    rule(name, name)(_aggregate)


def _result(a: Aggregate, v: Val, col: Column, name: str) -> Val:
    kind = a.kind or v.kind
    if name == "mean" and v.kind == "money":
        kind, col = "money", F.bround(col, 2).cast("decimal(18,2)")
    elif name == "exists":
        return Val("bool", F.coalesce(col, F.lit(0)) > 0)
    elif kind == "money":
        col = col.cast("decimal(18,2)")
    if a.zero is not None:
        zero = F.lit(a.zero).cast("decimal(18,2)") if kind == "money" else F.lit(a.zero).cast("bigint") if kind == "int" else F.lit(a.zero)
        return Val(kind, F.coalesce(col, zero))
    return Val(kind, col, True)


@rule(*AGGREGATES)
def _aggregate(c: Compiler, s: Scope, args: tuple, name: str) -> Val:
    if len(args) != 1:
        raise QueryError(f"{name} takes one argument")
    return _aggregated(c, s, AGGREGATES[name], args[0], name)


@rule("given_aggregate")
def _given(c: Compiler, s: Scope, args: tuple) -> Val:
    """An aggregate that the tree itself holds."""
    return _aggregated(c, s, args[0].value, args[1], "the aggregate")


def _aggregated(c: Compiler, s: Scope, a: Aggregate, tree: object, name: str) -> Val:
    if name == "count" and isinstance(tree, Call) and tree.name == "unique" and len(tree.args) == 1:
        q = c.compile(tree.args[0], s)
        if isinstance(q, Flow) and q.span is None:  # without a table of the distinct values
            keys = q.val.keys()
            distinct = lambda k: F.count_distinct(*[F.when(k, x) if k is not None else x for x in keys])
            return Val("int", F.coalesce(q.frame.aggregate(distinct, q.cond), F.lit(0).cast("bigint")), tag="count")
    q = c.compile(tree, s)
    v = q.val if isinstance(q, Flow) else q
    if a.takes and v.kind not in a.takes and v.kind != "null":
        raise QueryError(f"{name} has no meaning for {v.kind}")
    if isinstance(q, Val):
        if name in ("count", "exists"):
            n = F.when(q.present(), 1).otherwise(0).cast("bigint") if q.optional else F.lit(1).cast("bigint")
            return Val("int", n) if name == "count" else Val("bool", n > 0)
        if name == "mean":
            return Val("float", q.col.cast("double"), q.optional)
        return _result(a, q, q.col, name).named(None) if q.optional else Val(a.kind or q.kind, q.col)
    counted = name in ("count", "exists")
    x = F.lit(1) if counted and not v.optional else F.when(v.present(), 1) if counted and (v.cls or v.kind == "record") else v.col
    if q.span is not None:
        return _over(c, q, a, x, v, name)
    if q.frame.up is not s.frame:
        raise QueryError(f"{name} can't reach {tree}")
    if q.frame.theta is not None and not q.cond and (col := q.frame.theta.aggregate(a.make(F.col("x")), x, name)) is not None:
        return _result(a, v, col, name)
    make = lambda k: a.make(F.when(k, x) if k is not None else x)
    return _result(a, v, q.frame.aggregate(make, q.cond), name)


def _over(c: Compiler, q: Flow, a: Aggregate, x: Column, v: Val, name: str) -> Val:
    k = both(q.cond)
    x = F.when(k, x) if k is not None else x
    if q.span.name != "around":
        run = running(q, a.make(x), name)
        return _result(a, v, over(q, a.make(x)) if run is None else run, name)
    # all but the row itself
    there = F.when(x.isNotNull(), 1).otherwise(0)
    if name in ("count", "exists", "sum"):
        return _result(a, v, F.coalesce(over(q, a.make(x)), F.lit(0)) - F.coalesce(x if name == "sum" else there, F.lit(0)), name)
    n = over(q, F.count(x)) - there
    if name == "mean":
        total = over(q, F.sum(x)) - F.coalesce(x, F.lit(0))
        return _result(a, v, F.when(n > 0, total.cast("double") / n), name)
    if name in ("any", "all"):
        hits = over(q, F.count(F.when(x if name == "any" else ~x, 1))) - F.when(x if name == "any" else ~x, 1).otherwise(0)
        return Val("bool", hits > 0 if name == "any" else hits == 0)
    if name not in ("max", "min"):
        raise QueryError(f"{name}(around) is not defined; use and_around")
    # the best, how often it is there, and the next best
    best = over(q, a.make(x))
    often, second = over(q, F.count(F.when(x == best, 1))), over(q, a.make(F.when(x != best, x)))
    return _result(a, v, F.when(x.isNull() | (x != best) | (often > 1), best).otherwise(second), name)


__all__ = ["AGGREGATES", "define_aggregate"]
