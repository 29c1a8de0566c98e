"""Composition, projection and names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, TimestampType

from ..compiler import Bound, Compiler, Scope, bare, rule
from ..flow import Flow, Frame, Order, Val, fresh, settled
from ..syntax import Named, QueryError
from .theta import Theta


@rule("here")
def here(c: Compiler, s: Scope, args: tuple) -> Val:
    return s.focus


@rule("unlink")
def unlink(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """The query from the top, whatever is in focus."""
    return c.compile(args[0], Scope(s.frame, c.top.focus, s.env, s.border))


@rule("mix")
def mix(c: Compiler, s: Scope, args: tuple) -> Flow:
    """All combinations, as records with a field for each argument."""
    if not args:
        raise QueryError("mix needs arguments")
    flows = []
    for a in args:
        v = c.compile(a, s)
        if isinstance(v, Val):
            raise QueryError(f"mix needs many values, and {a} has one")
        flows.append(v)
    joined, vals = c.product(flows, s)
    fields = {}
    for k, (f, v) in enumerate(zip(flows, vals, strict=True)):
        name = f.val.tag or f"_{k + 1}"
        fields[name if name not in fields else f"{name}_{k + 1}"] = v.named(name)
    rec = Val("record", fields=fields)
    rec.defs["left"], rec.defs["right"] = [(v, rec, s.env, s.border) for v in (vals[0], vals[-1])]
    return replace(joined, val=rec)


@rule("left", "right")
def side(c: Compiler, s: Scope, args: tuple, name: str) -> Val:
    fields = list((s.focus.fields or {}).values())
    if not fields:
        raise QueryError(f"{name} needs a mix")
    return fields[0 if name == "left" else -1]


@rule("link")
def link(c: Compiler, s: Scope, args: tuple) -> Flow:
    """Values of the second argument, taken from the top, for which the first holds; ``left`` is what is in focus."""
    target = settled(c.flow(args[1], Scope(s.frame, c.top.focus, s.env, s.border), "link"))
    copy = c.fresh_copy(target, s)
    copy.frame.link = []
    theta = Theta(c, s, Frame(copy.frame.df, s.frame, [], copy.frame.rid, joined=copy.frame.joined), copy.val, args[0])
    copy.frame.attach()
    copy.frame.link = [(r, r) for r in s.frame.rid]
    both = Val("record", fields={"left": s.focus, "right": copy.val})
    out = where(c, s, Flow(copy.frame, both), args[0], keep=copy.val.named(target.val.tag))
    out.frame.theta = theta
    return out


def where(c: Compiler, s: Scope, flow: Flow, tree: object, keep: Val) -> Flow:
    p = c.val(tree, s.at(flow.frame, flow.val), "a condition")
    frame = flow.frame.derive(flow.frame.df.filter(p.col), attached=True)
    return Flow(frame, keep)


@rule("record")
def record(c: Compiler, s: Scope, args: tuple) -> Val:
    return fields_of(c, s, args, None)


def fields_of(c: Compiler, s: Scope, args: tuple, base: Val | None) -> Val:
    fields: dict = {}
    for k, a in enumerate(args):
        v = c.compile(a, s)
        name = (v.val if isinstance(v, Flow) else v).tag or f"_{k + 1}"
        if name in fields:
            name = f"{name}_{k + 1}"
        fields[name] = v
    return Val("record", fields=fields, base=base, tag=base.tag if base is not None else None, optional=base.optional if base is not None else False)


@rule("select")
def select(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """Records of the further arguments for each value of the first, which keep the value itself as their identity."""
    q = c.compile(args[0], s)
    if isinstance(q, Val):
        return fields_of(c, s.at(s.frame, q), args[1:], q)
    q = settled(q) if q.span is None else q
    return replace(q, val=fields_of(c, s.at(q.frame, q.val), args[1:], q.val))


@rule("define")
def define(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    q = c.compile(args[0], s)
    if isinstance(q, Flow) and q.span is None:
        q = settled(q)
    val = q.val if isinstance(q, Flow) else q
    defs = dict(val.defs)
    for a in args[1:]:
        if not isinstance(a, Named):
            raise QueryError(f"define needs a name for {a}")
        defs[a.name] = (a.query, replace(val, defs=dict(defs)), s.env, s.border)
    out = replace(val, defs=defs)
    return replace(q, val=out) if isinstance(q, Flow) else out


def bound(c: Compiler, s: Scope, bindings: tuple) -> Scope:
    """The scope with names bound to values at its input; later ones see earlier."""
    env = dict(s.env)
    for a in bindings:
        if not isinstance(a, Named):
            raise QueryError(f"given needs a name for {a}")
        v = c.compile(a.query, Scope(s.frame, s.focus, env, s.border))
        if isinstance(v, Val) and not v.cls and v.kind != "record" and not v.const:
            name = fresh("g")
            s.frame.df = s.frame.df.withColumn(name, v.col)
            v = replace(v, col=F.col(name))
        env = {**env, a.name: Bound(s.frame, v)}
    return Scope(s.frame, s.focus, env, s.border)


@rule("given")
def given(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """Binds names to values at the query's input; they can be used anywhere in the query.  Later ones see earlier."""
    return c.compile(args[0], bound(c, s, args[1:]))


@rule("as")
def named(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    name = bare(args[1])
    if name is None:
        raise QueryError("as needs a name")
    return c.compile(args[0], s).named(name)


@rule("frame")
def frame(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """The query with neighbours counted within each of its input rows."""
    return c.compile(args[0], Scope(s.frame, s.focus, s.env, s.frame))


@rule("get")
def get(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """The value with that identity, or none."""
    q, k = c.flow(args[0], s, "get"), c.val(args[1], s, "get")
    if not q.val.cls or len(q.val.ids) != 1:
        raise QueryError("get needs entities with a simple key")
    if not k.const:
        q.frame.reach(s.frame)
    frame = q.frame.derive(q.frame.df.filter(F.col(q.val.ids[0]) == k.col))
    return pick(c, s, Flow(frame, q.val, q.cond))


def pick(c: Compiler, s: Scope, flow: Flow, orders: list | None = None, *, flip: bool = False) -> Val:
    """The first row under each row above, as an optional value of the frame above."""
    if flow.frame.link and not flow.frame.attached and flow.frame.up is s.frame and flow.val.kind != "record":
        rank = ranked(flow.frame.df, orders or flow.frame.orders(), flip)
        if rank is not None:
            return _least(s, flow, *rank)
    flow = settled(flow)
    f = flow.frame
    if not f.attached and f.rid and f.rid[0] in s.frame.df.columns:  # picked from before, by another order
        orders, old = orders or f.orders(), f
        names = [fresh("o") for _ in orders]
        for n, o in zip(names, orders, strict=True):
            old.df = old.df.withColumn(n, o.col)
        old.order = [Order(F.col(n), o.desc, o.nulls_last) for n, o in zip(names, orders, strict=True)]
        flow = c.fresh_copy(flow, s)
        f, orders = flow.frame, flow.frame.order
    if not f.link and not f.attached:
        by = [o.sort(flip) for o in (orders or f.orders())]
        df = f.df.orderBy(*by).limit(1)
    else:
        numbered, n = f.numbered(flip=flip, orders=orders)
        df = numbered.filter(F.col(n) == 1).drop(n)
    above = s.frame
    mine = [x for x in df.columns if x not in set(above.df.columns)] if f.attached else list(df.columns)
    if not f.link:
        above.df = above.df.join(df, F.lit(True), "left")
    else:
        keys = {b: fresh("key" if b.startswith("key_") else "k") for _, b in f.link}
        right = df.select(*[F.col(b).alias(k) for b, k in keys.items()], *mine)
        cond = None
        for a, b in f.link:
            one = F.col(a).eqNullSafe(F.col(keys[b])) if b.startswith("key_") else F.col(a) == F.col(keys[b])
            cond = one if cond is None else cond & one
        above.df = above.df.join(right, cond, "left").drop(*keys.values())
    above.joined.update(f.joined)
    return optional(flow.val)


def ranked(df: DataFrame, orders: list[Order], flip: bool) -> tuple[Callable[[Column, Column], Column], Column] | None:
    """An aggregate (min_by or max_by) and a struct by which it finds the first row; none where a text has to be turned
    round beside another that has not."""
    kinds = [f.dataType for f in df.select(*[o.col.alias(f"o{i}") for i, o in enumerate(orders)]).schema.fields]
    nullable = [f.nullable for f in df.select(*[o.col.alias(f"o{i}") for i, o in enumerate(orders)]).schema.fields]
    for pick_one, turned in ((F.min_by, False), (F.max_by, True)):
        parts = []
        for o, kind, may in zip(orders, kinds, nullable, strict=True):
            down, last = (o.desc != flip) != turned, (o.nulls_last != flip) != turned
            if may:
                parts.append(o.col.isNull() if last else o.col.isNotNull())
            value = _turned(o.col, kind) if down else [o.col]
            if value is None:
                break
            parts += value
        else:
            return pick_one, F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])
    return None


def _turned(col: Column, kind: DataType) -> list[Column] | None:
    """Values that ascend where the column descends."""
    if isinstance(kind, IntegralType):
        return [F.bitwise_not(col)]
    if isinstance(kind, DecimalType):
        return [-col]
    if isinstance(kind, FractionalType):  # what is no number comes after all numbers
        return [~F.isnan(col), -col]
    if isinstance(kind, DateType):
        return [F.bitwise_not(F.unix_date(col))]
    if isinstance(kind, TimestampType):
        return [F.bitwise_not(F.unix_micros(col))]
    return [~col] if isinstance(kind, BooleanType) else None


def _least(s: Scope, flow: Flow, pick_one: Callable, key: Column) -> Val:
    """The values of the first row by one aggregate for each column, in the grouping that all aggregates of the child
    share; columns that nobody uses are left out of the plan."""
    f, v = flow.frame, flow.val
    one = lambda col, name=None: f.aggregate(lambda k: pick_one(col, F.when(k, key) if k is not None else key), flow.cond, name)
    if not v.cls:
        return replace(v, col=one(v.col), optional=True)
    names = {}

    def named(name: str) -> str:
        if name not in names:
            names[name] = fresh("f")
            one(F.col(name), names[name])
        return names[name]

    ids = tuple(named(i) for i in v.ids)
    for (cls, own), cols in f.joined.items():
        if own == v.ids:
            s.frame.joined[(cls, ids)] = {c: named(n) for c, n in cols.items()}
    return replace(v, ids=ids, optional=True)


def optional(v: Val) -> Val:
    if v.kind == "record":
        return replace(v, optional=True, base=optional(v.base) if v.base is not None else None, fields={k: optional(x) if isinstance(x, Val) else x for k, x in v.fields.items()})
    return replace(v, optional=True)
