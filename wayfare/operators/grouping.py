"""Groups, cubes, rollups, partitions and distinct values."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Frame, Order, Val, both, fresh, settled
from ..syntax import QueryError
from .navigate import optional, ranked


def _with_keys(f: Frame, keys: list[Val]) -> tuple[list[tuple[str, ...]], list[Val]]:
    """Adds the keys' columns to a frame; gives their names, and the keys in terms of them."""
    names, vals, df = [], [], f.df
    for k in keys:
        own = tuple(fresh("key") for _ in k.keys())
        for n, x in zip(own, k.keys(), strict=True):
            df = df.withColumn(n, x)
        names.append(own)
        vals.append(replace(k, ids=own) if k.cls else replace(k, col=F.col(own[0])))
    f.df = df
    return names, vals


def _key_values(c: Compiler, s: Scope, q: Flow, trees: tuple, what: str) -> list[Val]:
    out = []
    for k, t in enumerate(trees):
        v = c.val(t, s.at(q.frame, q.val), what)
        if v.kind == "record":
            raise QueryError(f"{what} needs plain keys")
        out.append(v.named(v.tag or f"_{k + 1}"))
    return out


def _expanded(df: DataFrame, names: list[tuple[str, ...]], masks: list[tuple[bool, ...]]) -> tuple[DataFrame, str]:
    """Each row once for each mask, with the keys that the mask leaves out set to null; and the mask's number."""
    gid, x = fresh("key"), fresh("x")
    sets = [
        F.struct(F.lit(sum((not keep) << i for i, keep in enumerate(m))).alias(gid), *[(F.col(n) if keep else F.lit(None).cast(df.schema[n].dataType)).alias(n) for own, keep in zip(names, m, strict=True) for n in own])
        for m in masks
    ]
    flat = [n for own in names for n in own]
    kept = [c for c in df.columns if c not in flat]
    return df.withColumn(x, F.explode(F.array(*sets))).select(*kept, *[F.col(f"{x}.{n}").alias(n) for n in [gid, *flat]]), gid


def _total_last(gid: str, i: int) -> Order:
    return Order(F.col(gid).bitwiseAND(F.lit(1 << i)) != 0)


def _grouped(c: Compiler, s: Scope, q: Flow, keys: list[Val], masks: list[tuple[bool, ...]] | None) -> Flow:
    names, vals = _with_keys(q.frame, keys)
    df, gid = q.frame.df, None
    if masks:
        df, gid = _expanded(df, names, masks)
        vals = [optional(v) for v in vals]
    f = q.frame
    flat = [n for own in names for n in own]
    above = {b: fresh("key" if b.startswith("key_") else "k") for b in f.own()}
    mine = {n: fresh("key") for n in [*flat, *([gid] if gid else [])]}
    members = Frame(df, None, [(above[b], b) for b in above] + [(g, n) for n, g in mine.items()], f.rid, f.order, attached=False, joined=f.joined)

    def rows() -> DataFrame:
        aggs = [x for child, todo in group.pending if child is members for x in todo]
        group.pending = [p for p in group.pending if p[0] is not members]
        if not members.link:  # one group, of no rows too, but in the second dialect
            some = fresh("some")
            one = members.df.agg(F.count(F.lit(1)).alias(some), *[m(k).alias(n) for n, m, k in aggs])
            return one.filter(F.col(some) > 0) if c.dialect == "v2" else one
        out = members.aggregated(aggs, every=True)
        if gid:  # the total is there for no rows too
            out = _with_totals(f, members, out, above, gid, sum(1 << i for i in range(len(keys))), aggs)
        return out.select(*[F.col(b).alias(n) for b, n in above.items()], *[F.col(n).alias(g) for n, g in mine.items()], *[n for n, *_ in aggs])

    order = []
    for i, (own, k) in enumerate(zip(names, keys, strict=True)):
        if gid:
            order.append(_total_last(mine[gid], i))
        order += [Order(F.col(mine[n]), k.desc, k.nulls_last) for n in own]
    group = Frame(rows, f.up, [(a, above[b]) for a, b in f.link], list(mine.values()), order)
    members.up = group
    fields: dict = {}
    for own, v in zip(names, vals, strict=True):
        fields[v.tag] = replace(v, ids=tuple(mine[n] for n in own)) if v.cls else replace(v, col=F.col(mine[own[0]]))
    fields.setdefault(q.val.tag or "group", Flow(members, q.val))
    rec = Val("record", fields=fields)
    if gid:
        rec.defs = {}
    return Flow(group, rec)


def _with_totals(f: Frame, members: Frame, groups: DataFrame, above: dict[str, str], gid: str, full: int, aggs: list) -> DataFrame:
    """The groups, and the totals of rows above that have no members: aggregates of nothing."""
    nothing = members.df.filter(F.lit(False)).agg(F.count(F.lit(1)).alias("_n"), *[m(k).alias(n) for n, m, k in aggs]).drop("_n")
    if f.own():
        owners = f.up.df.select(*[F.col(a).alias(b) for a, b in f.link]).distinct()
        there = members.df.select(*[F.col(b).alias(f"{b}_t") for b in f.own()]).distinct()
        lone = owners.join(there, both(tuple(F.col(b).eqNullSafe(F.col(f"{b}_t")) for b in f.own())), "left_anti").crossJoin(F.broadcast(nothing))
    else:
        there = members.df.limit(1).select(F.lit(1).alias("_t"))  # not of the groups, which would be made twice
        lone = nothing.join(there, F.lit(True), "left_anti")
    return groups.unionByName(lone.withColumn(gid, F.lit(full)), allowMissingColumns=True)


@rule("group", "group_cube", "rollup")
def group(c: Compiler, s: Scope, args: tuple, name: str) -> Flow:
    """Records of keys and the values that have them; with a cube or rollup also the totals, which come last."""
    q = settled(c.flow(args[0], s, name))
    q = replace(q, frame=q.frame.derive(q.frame.df))
    keys = _key_values(c, s, q, args[1:], name)
    masks = None
    if name == "group_cube":
        masks = list(itertools.product((True, False), repeat=len(keys)))
    elif name == "rollup":
        masks = [tuple(i < n for i in range(len(keys))) for n in range(len(keys), -1, -1)]
    return _grouped(c, s, q, keys, masks)


@rule("partition", "partition_cube")
def partition(c: Compiler, s: Scope, args: tuple, name: str) -> Flow:
    """Groups by given values of each key: those without members too, and none beside them."""
    q = settled(c.flow(args[0], s, name))
    q = replace(q, frame=q.frame.derive(q.frame.df))
    dims = [c.flow(t, s, name) for t in args[1:]]
    if not dims:
        raise QueryError(f"{name} needs keys")
    keys = []
    for d in dims:
        if not d.val.tag:
            raise QueryError(f"{name} needs names for its keys")
        k = c.member(d.val.tag, s.at(q.frame, q.val))
        if not isinstance(k, Val):
            raise QueryError(f"{name} has no plain key {d.val.tag}")
        keys.append(k.named(d.val.tag))
    names, _ = _with_keys(q.frame, keys)
    grid, vals = c.product(dims, s)
    g = grid.frame
    dim_names, vals = _with_keys(g, vals)
    vals = [v.named(k.tag) for v, k in zip(vals, keys, strict=True)]
    outer = [(x, y) for (a, x) in g.link for (b, y) in q.frame.link if a == b]
    flat, dim_flat = [n for own in names for n in own], [n for own in dim_names for n in own]
    df, up, order = q.frame.df, g, []
    if name == "partition_cube":
        masks = list(itertools.product((True, False), repeat=len(keys)))
        on = both(tuple(F.col(a).eqNullSafe(F.col(b)) for a, b in [*zip(dim_flat, flat, strict=True), *outer]))
        df = df.join(g.df.select(*dim_flat, *[x for x, _ in outer]).distinct(), on, "left_semi")
        df, gid = _expanded(df, names, masks)
        own = g.own()
        cells, dim_gid = _expanded(g.df.select(*own, *dim_flat), dim_names, masks)
        full = cells.filter(F.col(dim_gid) == 0)
        up = Frame(full.unionByName(cells.filter(F.col(dim_gid) != 0).distinct()), g.up, g.link, [dim_gid, *dim_flat])
        flat, dim_flat, vals = [*flat, gid], [*dim_flat, dim_gid], [optional(v) for v in vals]
        for i, ns in enumerate(dim_names):
            order += [_total_last(dim_gid, i), *[Order(F.col(n)) for n in ns]]
    else:
        order = list(g.order)
    up.order = order
    members = Frame(df, up, [*outer, *zip(dim_flat, flat, strict=True)], q.frame.rid, q.frame.order, joined=q.frame.joined)
    fields: dict = {v.tag: v for v in vals}
    fields.setdefault(q.val.tag or "group", Flow(members, q.val))
    return Flow(up, Val("record", fields=fields))


@rule("unique")
def unique(c: Compiler, s: Scope, args: tuple) -> Flow:
    """Distinct values, sorted; in the second dialect in the order in which they come first."""
    q = settled(c.flow(args[0], s, "unique"))
    f, v = q.frame, q.val
    parts = list(v.fields.values()) if v.kind == "record" and v.base is None else [v]
    if any(not isinstance(p, Val) or p.kind == "record" for p in parts):
        raise QueryError("unique needs plain values")
    work = f.derive(f.df)
    names, vals = _with_keys(work, parts)
    flat = [n for own in names for n in own]
    above = {b: fresh("key" if b.startswith("key_") else "k") for b in f.own()}
    keys = [F.col(b).alias(n) for b, n in above.items()]
    if c.dialect == "v2":
        place, orders = fresh("place"), f.orders()
        rank = ranked(work.df, orders, False) if orders else (F.min_by, F.struct(F.lit(0)))
        if rank is None or rank[0] is not F.min_by:  # an order that no struct has: numbers it
            numbered, n = work.numbered()
            rank, work = (F.min_by, F.struct(n)), f.derive(numbered)
        df = work.df.groupBy(*keys, *flat).agg(F.min(rank[1]).alias(place))
        order = [Order(F.col(place))]
    else:
        df = work.df.select(*keys, *flat).distinct()
        order = [Order(F.col(n), p.desc, p.nulls_last) for own, p in zip(names, parts, strict=True) for n in own]
    frame = Frame(df, f.up, [(a, above[b]) for a, b in f.link], flat, order)
    if v.kind == "record" and v.base is None:
        return Flow(frame, replace(v, fields=dict(zip(v.fields, vals, strict=True))))
    return Flow(frame, replace(vals[0], defs=v.defs))
