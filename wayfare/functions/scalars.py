"""Scalar functions on values: their types and columns."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..flow import Val
from ..syntax import QueryError, Regex

MONEY = "decimal(18,2)"
NUMBERS = ("int", "float", "money")


def literal(value: object) -> Val:
    if value is None:
        return Val("null", F.lit(None), optional=True, const=True)
    kinds = ((bool, "bool"), (int, "int"), (float, "float"), (str, "str"), (datetime.datetime, "time"), (datetime.date, "date"))
    for t, kind in kinds:
        if isinstance(value, t):
            return Val(kind, F.lit(value).cast("bigint") if kind == "int" else F.lit(value), const=True)
    raise QueryError(f"{value!r} can't be a value of a query")


def _result(kind: str, col: Column, *args: Val) -> Val:
    return Val(kind, col, any(a.optional for a in args))


def _strict(col: Column, *args: Val) -> Column:
    """No value as soon as an operand has none, where the engine's logic would give one."""
    for a in args:
        if a.optional:
            col = F.when(a.col.isNotNull(), col)
    return col


def _rounded(col: Column) -> Column:
    return F.bround(col, 2).cast(MONEY)


def _arith(op: str, a: Val, b: Val) -> Val:
    x, y = a.col, b.col
    if "null" in (a.kind, b.kind):
        return Val("null", F.lit(None), optional=True)
    if a.kind == "period" or b.kind == "period":
        return _period(op, a, b)
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        raise QueryError(f"{op} has no meaning for {a.kind} and {b.kind}")
    kinds = {a.kind, b.kind}
    if op in "+-":
        if kinds == {"money"}:
            return _result("money", (x + y if op == "+" else x - y).cast(MONEY), a, b)
        if "money" in kinds:
            raise QueryError(f"{op} has no meaning for {a.kind} and {b.kind}")
        return _result("int" if kinds == {"int"} else "float", x + y if op == "+" else x - y, a, b)
    if op == "*":
        if kinds == {"money"}:
            raise QueryError("money can't be multiplied by money")
        if "money" in kinds:
            return _result("money", _rounded(x * y), a, b)
        return _result("int" if kinds == {"int"} else "float", x * y, a, b)
    if op == "÷" or kinds == {"int"}:
        return Val("int", F.call_function("div", x, y), a.optional or b.optional)
    if kinds == {"money"}:
        return _result("float", x.cast("double") / y.cast("double"), a, b)
    if a.kind == "money":
        return _result("money", _rounded(x / y), a, b)
    return _result("float", x.cast("double") / y.cast("double"), a, b)


def _period(op: str, a: Val, b: Val) -> Val:
    if op == "*" and {a.kind, b.kind} == {"int", "period"}:
        n, p = (a, b) if a.kind == "int" else (b, a)
        return Val("period", F.struct((p.col["months"] * n.col).cast("int").alias("months"), (p.col["days"] * n.col).cast("int").alias("days")), a.optional or b.optional)
    if op in "+-" and a.kind == b.kind == "period":
        s = 1 if op == "+" else -1
        return _result("period", F.struct((a.col["months"] + s * b.col["months"]).alias("months"), (a.col["days"] + s * b.col["days"]).alias("days")), a, b)
    if op == "+" and a.kind == "period":
        a, b = b, a
    if op in "+-" and a.kind in ("date", "time") and b.kind == "period":
        s = 1 if op == "+" else -1
        moved = F.date_add(F.add_months(a.col.cast("date"), s * b.col["months"]), s * b.col["days"])
        return _result("date", moved, a, b)
    raise QueryError(f"{op} has no meaning for {a.kind} and {b.kind}")


def _compare(op: str, a: Val, b: Val) -> Val:
    fns: dict[str, Callable[[Column, Column], Column]] = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    if "null" in (a.kind, b.kind):
        return Val("bool", F.lit(None).cast("boolean"), True)
    if a.cls or b.cls:  # entities are equal if their ids are
        if not (a.cls and b.cls) or a.cls is not b.cls or op not in ("==", "!="):
            raise QueryError(f"{op} has no meaning for {a.cls.name if a.cls else a.kind} and {b.cls.name if b.cls else b.kind}")
        pairs = [F.col(x) == F.col(y) for x, y in zip(a.ids, b.ids, strict=True)]
        same = pairs[0]
        for p in pairs[1:]:
            same = same & p
        return Val("bool", same if op == "==" else ~same, a.optional or b.optional)
    families = [{"int", "float", "money"}, {"str"}, {"bool"}, {"date", "time"}, {"any"}]
    if not any(a.kind in f and b.kind in f for f in families):
        raise QueryError(f"{a.kind} can't be compared with {b.kind}")
    return _result("bool", fns[op](a.col, b.col), a, b)


def _logic(op: str, a: Val, b: Val) -> Val:
    for v in (a, b):
        if v.kind not in ("bool", "null"):
            raise QueryError(f"{op} needs true or false, not {v.kind}")
    return _result("bool", _strict(a.col & b.col if op == "&" else a.col | b.col, a, b), a, b)


def _text(name: str, a: Val, b: Val) -> Val:
    if a.kind != "str":
        raise QueryError(f"{name} needs a text, not {a.kind}")
    return _result("bool", getattr(a.col, name)(b.col), a, b)


def contains(a: Val, b: Val | Regex) -> Val:
    if isinstance(b, Regex):
        return _result("bool", a.col.rlike(b.pattern), a)
    return _text("contains", a, b)


def _substr(s: Val, i: Val, j: Val) -> Val:
    """From the i-th to the j-th character, both included."""
    return _result("str", F.substring(s.col, i.col.cast("int"), F.greatest(j.col - i.col + 1, F.lit(0)).cast("int")), s, i, j)


def _unit(months: int, days: int) -> Callable[..., Val]:
    def make(*args: Val) -> Val:
        one = Val("period", F.struct(F.lit(months).alias("months"), F.lit(days).alias("days")))
        if not args:
            return one
        part = F.year if months == 12 else F.month if months else F.dayofmonth
        if args[0].kind == "int":
            return _period("*", args[0], one)
        if args[0].kind not in ("date", "time"):
            raise QueryError("a date is needed")
        return _result("int", part(args[0].col).cast("bigint"), *args)

    return make


def _negate(a: Val) -> Val:
    if a.kind not in NUMBERS:
        raise QueryError(f"- has no meaning for {a.kind}")
    return replace(a, col=-a.col, tag=None)


def _not(a: Val) -> Val:
    if a.kind not in ("bool", "null"):
        raise QueryError(f"! needs true or false, not {a.kind}")
    return _result("bool", ~a.col, a)


def _date(s: Val) -> Val:
    return _result("date", F.to_date(s.col), s)


def _usd(*args: Val) -> Val:
    return Val("money", F.lit(1).cast(MONEY))


SCALARS: dict[str, Callable[..., Val]] = {
    **{op: (lambda a, b, op=op: _arith(op, a, b)) for op in ("*", "/", "÷")},
    "+": lambda a, *b: _arith("+", a, b[0]) if b else a,
    "-": lambda a, *b: _arith("-", a, b[0]) if b else _negate(a),
    **{op: (lambda a, b, op=op: _compare(op, a, b)) for op in ("==", "!=", "<", "<=", ">", ">=")},
    **{op: (lambda a, b, op=op: _logic(op, a, b)) for op in ("&", "|")},
    "!": _not,
    "startswith": lambda a, b: _text("startswith", a, b),
    "endswith": lambda a, b: _text("endswith", a, b),
    "contains": contains,
    "substr": _substr,
    "date": _date,
    "_usd": _usd,
    **{n: _unit(*u) for u, names in (((0, 1), "day _day days _days"), ((1, 0), "month _month months _months"), ((12, 0), "year _year years _years")) for n in names.split()},
}
