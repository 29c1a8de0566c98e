"""Unions of flows, tagged unions, and choices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Frame, Order, Val, both, fresh
from ..syntax import QueryError


def _arm(s: Scope, v: Val | Flow, names: list[str], rids: list[str], arm: str, n: int, cond: Column | None) -> tuple[DataFrame, list[Order]]:
    """Rows of one argument: keys of the row above, number of the argument, columns of its own order, and values; and
    that order."""
    val = v.val if isinstance(v, Flow) else v
    cols = [F.col(i) for i in val.ids] if val.cls else [val.col]
    orders: list[tuple[str, Order]] = []
    if isinstance(v, Flow):
        v.frame.reach(s.frame)
        conds = tuple(x for x in (*v.cond, cond) if x is not None)
        df = v.frame.df.filter(both(conds)) if conds else v.frame.df
        orders = [(fresh("key"), o) for o in v.frame.orders()]
    else:
        conds = tuple(x for x in (val.present() if val.optional else None, cond) if x is not None)
        df = s.frame.df.filter(both(conds)) if conds else s.frame.df
    df = df.select(*[F.col(r).alias(k) for r, k in zip(s.frame.rid, rids, strict=True)], F.lit(n).alias(arm), *[o.col.alias(k) for k, o in orders], *[x.alias(m) for x, m in zip(cols, names, strict=True)])
    return df, [Order(F.col(k), o.desc, o.nulls_last) for k, o in orders]


def _stacked(s: Scope, values: list[Val | Flow], names: list[list[str]], rids: list[str], conds: list[Column | None]) -> tuple[Frame, str]:
    """The arguments' rows, one's after the other's; columns of an argument's order are null for the others'."""
    arm, df, orders = fresh("arm"), None, []
    for n, v in enumerate(values):
        one, own = _arm(s, v, names[n], rids, arm, n, conds[n])
        df = one if df is None else df.unionByName(one, allowMissingColumns=True)
        orders += own
    every = list(dict.fromkeys(x for own in names for x in own))
    frame = Frame(df, s.frame, list(zip(s.frame.rid, rids, strict=True)), [*rids, arm, *[c for c in df.columns if c not in (*rids, arm, *every)], *every], [Order(F.col(arm)), *orders])
    frame.explicit = any(isinstance(v, Flow) and v.frame.explicit for v in values)
    return frame, arm


def merged(c: Compiler, s: Scope, values: list[Val | Flow], conds: list[Column | None] | None = None) -> Flow:
    """All values of several queries under each row above, one query's after the other's, each in its own order."""
    vals = [v.val if isinstance(v, Flow) else v for v in values]
    if not vals or any(v.kind == "record" for v in vals):
        raise QueryError("plain values are needed")
    if len({v.cls.name if v.cls else v.kind for v in vals if v.kind != "null"}) > 1:
        raise QueryError("values of one type are needed")
    model = next((v for v in vals if v.kind != "null"), vals[0])
    names = [fresh("key") for _ in (model.ids or [0])]
    arms = [(v, conds[n] if conds else None) for n, v in enumerate(values) if (v.val if isinstance(v, Flow) else v).kind != "null"] or [(values[0], None)]
    frame, _ = _stacked(s, [v for v, _ in arms], [names] * len(arms), [fresh("k") for _ in s.frame.rid], [k for _, k in arms])
    val = replace(model, ids=tuple(names), optional=False) if model.cls else replace(model, col=F.col(names[0]), optional=False, const=False)
    return Flow(frame, val)


@rule("merge")
def merge(c: Compiler, s: Scope, args: tuple) -> Flow:
    return merged(c, s, [c.compile(a, s) for a in args])


@rule("pack")
def pack(c: Compiler, s: Scope, args: tuple) -> Flow:
    """Values of different types, one argument's after the other's: records of which one field is there, whose name is
    that of the argument."""
    arms = [c.compile(a, s) for a in args]
    tags = [(v.val if isinstance(v, Flow) else v).tag or f"_{n + 1}" for n, v in enumerate(arms)]
    if len(set(tags)) < len(tags):
        raise QueryError("pack needs different names")
    names, fields = [], {}
    for v, tag in zip(arms, tags, strict=True):
        val = v.val if isinstance(v, Flow) else v
        if val.kind == "record":
            raise QueryError("pack needs plain values")
        own = [fresh("key") for _ in (val.ids or [0])]
        names.append(own)
        fields[tag] = replace(val, ids=tuple(own), optional=True, const=False) if val.cls else replace(val, col=F.col(own[0]), optional=True, const=False)
    frame, arm = _stacked(s, arms, names, [fresh("k") for _ in s.frame.rid], [None] * len(arms))
    names_of = F.element_at(F.array(*[F.lit(t) for t in tags]), F.col(arm) + 1)
    return Flow(frame, Val("record", fields={"tag": Val("str", names_of), **fields}))


@rule("switch")
def switch(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """switch(test, query, ..., otherwise): the query of the first test that is true; a missing test gives nothing."""
    tests = [c.val(t, s, "a test") for t in args[: len(args) - len(args) % 2 : 2]]
    arms = [c.compile(a, s) for a in (*args[1::2], *([args[-1]] if len(args) % 2 else []))]
    conds: list[Column] = []
    clear = F.lit(True)
    for t in tests:
        conds.append(clear & F.coalesce(t.col, F.lit(False)))
        clear = clear & F.coalesce(~t.col, F.lit(False))
    if len(args) % 2:
        conds.append(clear)
    if all(isinstance(a, Val) and not a.cls and a.kind != "record" for a in arms):
        kinds = {a.kind for a in arms} - {"null"}
        if len(kinds) > 1:
            raise QueryError("the choices need one type")
        out = F.when(conds[0], arms[0].col)
        for k, a in zip(conds[1:], arms[1:], strict=True):
            out = out.when(k, a.col)
        return Val(kinds.pop() if kinds else "null", out, any(a.optional for a in arms) or any(t.optional for t in tests) or len(args) % 2 == 0)
    return merged(c, s, arms, conds)


@rule("then_else")
def then_else(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """The second argument where the first is true, the third where it is false."""
    return switch(c, s, args)


@rule("expect_one", "expect_at_most_one", "expect_at_least_one", "expect_anything")
def expect(c: Compiler, s: Scope, args: tuple, name: str) -> Val | Flow:
    """The query's values, with an error when the query runs if there are more or fewer for an input."""
    q = c.compile(args[0], s)
    if name == "expect_anything":
        return q
    low, high = name in ("expect_one", "expect_at_least_one"), name in ("expect_one", "expect_at_most_one")
    if isinstance(q, Val):
        if not low or not q.optional:
            return q
        if q.cls or q.kind == "record":
            raise QueryError(f"{name} needs plain values or many")
        checked = F.when(q.col.isNotNull(), q.col).otherwise(F.raise_error(F.lit(f"{name}: no value")))
        return replace(q, col=checked, optional=False)
    n = q.frame.aggregate(lambda k: F.count(F.when(k, 1) if k is not None else F.lit(1)), q.cond)
    n = F.coalesce(n, F.lit(0))
    wrong = (n < 1) if low and not high else (n > 1) if high and not low else (n != 1)
    guard = F.when(wrong, F.raise_error(F.concat(F.lit(f"{name}: "), n.cast("string"), F.lit(" values"))).cast("boolean")).otherwise(F.lit(True))
    s.frame.df = s.frame.df.filter(guard)
    if high:
        from .navigate import pick

        v = pick(c, s, q)
        return v if not low else replace(v, optional=False)
    return q
