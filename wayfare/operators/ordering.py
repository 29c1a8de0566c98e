"""Order, parts of a sequence, and sequences of given values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Frame, Order, Val, fresh, settled
from ..syntax import QueryError
from .navigate import optional, pick


@rule("asc", "desc", "nullfirst", "nulllast")
def flag(c: Compiler, s: Scope, args: tuple, name: str) -> Val | Flow:
    v = c.compile(args[0], s)
    change = {"asc": {"desc": False}, "desc": {"desc": True}, "nullfirst": {"nulls_last": False}, "nulllast": {"nulls_last": True}}[name]
    return replace(v, val=replace(v.val, **change)) if isinstance(v, Flow) else replace(v, **change)


@rule("sort")
def sort(c: Compiler, s: Scope, args: tuple) -> Flow:
    """By the keys, or else by the values; what is equal keeps its order.  Missing keys come first unless told."""
    q = settled(c.flow(args[0], s, "sort"))
    keys = [c.val(k, s.at(q.frame, q.val), "a key") for k in args[1:]] or [q.val]
    orders = [Order(x, k.desc, k.nulls_last) for k in keys for x in k.keys()]
    frame = q.frame.derive(lambda: q.frame.df, order=[*orders, *q.frame.order])
    frame.explicit = True
    return Flow(frame, replace(q.val, desc=False))


@rule("reverse")
def reverse(c: Compiler, s: Scope, args: tuple) -> Flow:
    q = settled(c.flow(args[0], s, "reverse"))
    turned = [Order(o.col, not o.desc, not o.nulls_last) for o in q.frame.orders()]
    frame = q.frame.derive(lambda: q.frame.df, order=turned)
    frame.explicit = True
    return Flow(frame, q.val)


@rule("take", "skip")
def part(c: Compiler, s: Scope, args: tuple, name: str) -> Flow:
    """The first n values, or all after them; a negative n counts from the end, and no n takes everything."""
    q, n = settled(c.flow(args[0], s, name)), c.val(args[1], s, name)
    f = q.frame
    if n.kind == "null":
        return q
    if n.kind != "int":
        raise QueryError(f"{name} needs a whole number")
    if n.const and not f.own():
        k = _number(args[1])
        if k is not None:
            return Flow(_cut(f, k, name), q.val)
    if s.frame is c.root and not f.own():  # one number for the whole query: asked for first, so that a limit can use it
        k = s.frame.df.select(n.col.alias("n")).first().n
        return q if k is None else Flow(_cut(f, k, name), q.val)
    if not n.const:
        f.reach(s.frame)
    rn, total = fresh("n"), fresh("n")
    by = [o.sort() for o in f.orders()] or [F.lit(0)]
    df = f.df.withColumn(rn, F.row_number().over(Window.partitionBy(*f.own()).orderBy(*by)))
    df = df.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*f.own())))
    last = F.when(n.col >= 0, n.col).otherwise(F.greatest(F.col(total) + n.col, F.lit(0)))
    kept = F.col(rn) <= last if name == "take" else F.col(rn) > last
    return Flow(f.derive(df.filter(n.col.isNull() | kept if n.optional else kept).drop(rn, total)), q.val)


def _number(tree: object) -> int | None:
    value = getattr(tree, "value", None)
    if isinstance(value, int):
        return value
    args = getattr(tree, "args", ())
    if getattr(tree, "name", "") == "-" and len(args) == 1 and isinstance(getattr(args[0], "value", None), int):
        return -args[0].value
    return None


def _cut(f: Frame, k: int, name: str) -> Frame:
    """A top-level part: a limit, from the end in the opposite order."""
    forward, back = [o.sort() for o in f.orders()], [o.sort(flip=True) for o in f.orders()]
    by = lambda order: f.df.orderBy(*order) if order else f.df
    if name == "take":
        df = by(forward).limit(k) if k >= 0 else by(back).offset(-k)
    else:
        df = by(forward).offset(k) if k >= 0 else by(back).limit(-k)
    out = f.derive(df)
    out.explicit = out.explicit or (name == "take") == (k >= 0)  # what a limit gives is small enough to be kept in order
    return out


@rule("first", "last")
def first(c: Compiler, s: Scope, args: tuple, name: str) -> Val:
    """The first value; or with a key the one with the greatest key (of equals the earliest), last: the least."""
    q = c.compile(args[0], s)
    if isinstance(q, Val):
        return optional(q)
    if q.span is not None:
        return _neighbour(c, q, name, args[1:], s)
    if len(args) == 1:
        return pick(c, s, q, flip=(name == "last") != q.val.desc)
    if len(args) != 2:
        raise QueryError(f"{name} takes one key")
    k = c.val(args[1], s.at(q.frame, q.val), "a key")
    if k.optional:
        q = replace(q, cond=(*q.cond, k.present()))
    down = (name == "first") != k.desc
    return pick(c, s, q, [*[Order(x, down) for x in k.keys()], *q.frame.orders()])


def _neighbour(c: Compiler, q: Flow, name: str, keys: tuple, s: Scope) -> Val:
    from .windows import kept, neighbour, window

    if keys or q.val.kind == "record":
        raise QueryError(f"{name} of neighbours takes plain values and no key")
    cond = None
    for x in q.cond:
        cond = x if cond is None else cond & x
    skip = cond is not None

    def one(col: Column, skip: bool) -> Column:
        col = col if cond is None else F.when(cond, col)
        if q.span.name.endswith("around"):
            return kept(q, (F.first if name == "first" else F.last)(col, ignorenulls=skip).over(window(q)))
        first_is_nearest = q.span.name.endswith("after") or c.dialect == "v1"
        return neighbour(q, col, nearest=(name == "first") == first_is_nearest, skip=skip)

    if q.val.cls:
        names = []
        for i in q.val.ids:
            n, col = fresh("k"), one(F.col(i), skip)
            q.frame.df = q.frame.df.withColumn(n, col)
            names.append(n)
        return replace(q.val, ids=tuple(names), optional=True)
    return replace(q.val, col=one(q.val.col, skip or q.val.optional), optional=True)


def exploded(s: Scope, array: object, kind: str, tag: str | None) -> Flow:
    """The elements of an array column as a flow."""
    pos, x = fresh("pos"), fresh("x")
    df = s.frame.df.select("*", F.posexplode(array).alias(pos, x))
    frame = Frame(df, s.frame, [(r, r) for r in s.frame.rid], [*s.frame.rid, pos], [Order(F.col(pos))], attached=True, joined=s.frame.joined)
    return Flow(frame, Val(kind, F.col(x), tag=tag))


@rule("range")
def number_range(c: Compiler, s: Scope, args: tuple) -> Flow:
    """Whole numbers from start by step up to stop, which is included; none if any of the three is missing."""
    a, step, b = [c.val(x, s, "range") for x in args]
    if {v.kind for v in (a, step, b)} - {"int", "null"}:
        raise QueryError("range needs whole numbers")
    none = F.array().cast("array<bigint>")
    runs = ((step.col > 0) & (a.col <= b.col)) | ((step.col < 0) & (a.col >= b.col))
    seq = F.when(runs, F.sequence(a.col, F.when(runs, b.col).otherwise(a.col), F.when(runs, step.col).otherwise(F.lit(0).cast("bigint")))).otherwise(none)
    return exploded(s, F.coalesce(seq, none), "int", None)


@rule("array")
def array(c: Compiler, s: Scope, args: tuple) -> Flow:
    """The arguments' values one after the other."""
    vals = [c.compile(a, s) for a in args]
    if any(isinstance(v, Flow) or v.cls or v.kind == "record" for v in vals):
        from .unions import merged

        return merged(c, s, vals)
    kinds = {v.kind for v in vals} - {"null"}
    if len(kinds) > 1:
        raise QueryError("an array needs values of one type")
    items = F.filter(F.array(*[v.col for v in vals]), lambda x: x.isNotNull())
    return exploded(s, items, kinds.pop() if kinds else "null", None)
