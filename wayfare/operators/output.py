"""Results: tables, nested values and JSON."""

from __future__ import annotations

import math
from dataclasses import replace
from html import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Val, both, settled
from ..syntax import QueryError
from .navigate import fields_of


def shown(c: Compiler, s: Scope, v: Val) -> dict[str, Val | Flow]:
    """What is shown of an entity: its class's choice, or all its attributes."""
    names = v.cls.select or [a.name for a in v.cls.arrows.values() if a.column]
    return {n: c.member(n, s.at(s.frame, replace(v, defs={}))) for n in names}


def _parts(c: Compiler, s: Scope, v: Val) -> dict[str, Val | Flow] | None:
    return shown(c, s, v) if v.cls else v.fields if v.kind == "record" else None


def column(c: Compiler, s: Scope, v: Val | Flow) -> Column:
    """One column for a value: a struct for an entity or record, an array for many values."""
    if isinstance(v, Flow):
        return _array(c, s, c.hung(v, s))
    parts = _parts(c, s, v)
    if parts is None:
        return F.lit(None).cast("string") if v.kind == "null" else v.col
    made = F.struct(*[column(c, s, x).alias(n) for n, x in parts.items()])
    return F.when(v.present(), made) if v.optional else made


def _array(c: Compiler, s: Scope, v: Flow) -> Column:
    if v.span is not None:
        return _span(c, s, v)
    f = v.frame
    inner = s.at(f, v.val)
    value = column(c, inner, v.val)
    orders = f.orders()
    if any(o.desc or o.nulls_last for o in orders):
        v = settled(v)
        numbered, n = v.frame.numbered()
        v.frame.df = numbered
        if v.frame is not f:
            v = replace(v, frame=v.frame)
        f, by = v.frame, [F.col(n)]
        f.up = s.frame
    else:
        by = [o.col for o in orders]
    item = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(by)], value.alias("v"))
    made = f.aggregate(lambda k: F.collect_list(F.when(k, item) if k is not None else item), v.cond)
    sorted_items = F.transform(F.array_sort(made), lambda x: x["v"])
    return F.coalesce(sorted_items, F.array())


def _span(c: Compiler, s: Scope, v: Flow) -> Column:
    """The neighbours' values in their order; before: the nearest first."""
    from .windows import kept, listed, place, window

    value, n = kept(v, column(c, s, v.val)), place(v)
    k = both(v.cond)
    item = F.struct(n.alias("n"), value.alias("v"))
    if v.span.name.endswith("around"):
        return _around(v, n, k, listed(v, F.when(k, item) if k is not None else item, n))
    made = F.array_sort(kept(v, F.collect_list(F.when(k, item) if k is not None else item).over(window(v))))
    values = F.transform(made, lambda x: x["v"])
    if _drops(v):
        values = F.filter(values, lambda x: x.isNotNull())
    return F.reverse(values) if v.span.name in ("before", "and_before") and c.dialect == "v1" else values


def _drops(v: Flow) -> bool:
    """Whether missing values are left out of a list."""
    return v.val.optional and not v.val.cls and v.val.kind != "record"


def _around(v: Flow, n: Column, k: Column | None, places: Column) -> Column:
    """A group's list without the row itself."""
    values = places["v"]
    if v.span.name == "around":
        at = F.array_position(places["n"], n).cast("int")  # 0 where the row is not in the list
        rest = F.concat(F.slice(values, F.lit(1), at - 1), F.slice(values, at + 1, F.size(values)))
        values = F.when(at > 0, rest).otherwise(values) if k is not None else F.concat(F.slice(values, F.lit(1), n - 1), F.slice(values, n + 1, F.size(values)))
    return F.filter(values, lambda x: x.isNotNull()) if _drops(v) else values


def table(c: Compiler, v: Val | Flow) -> DataFrame:
    """The result of a query as a DataFrame: a row for each value, a column for each field."""
    if isinstance(v, Flow):
        v = settled(v)
        frame, val = v.frame, v.val
        if frame.up is not c.root:
            raise QueryError("the query hangs on nothing")
        if frame.link:
            frame.attach()  # to the one row that it starts from
    else:
        frame, val = c.root, v
    s = c.top.at(frame, val)
    parts = _parts(c, s, val)
    cols = [column(c, s, x).alias(n) for n, x in parts.items()] if parts is not None else [column(c, s, val).alias(val.tag or "value")]
    df = frame.df
    if isinstance(v, Val) and v.optional:
        df = df.filter(v.present())
    if isinstance(v, Flow) and frame.explicit:
        df = df.orderBy(*[o.sort() for o in frame.orders()])
    return df.select(*cols)


@rule("json")
def json(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """Texts of JSON objects of the fields, or of what is shown; fields without a name are left out."""
    q = c.compile(args[0], s)
    flow = settled(q) if isinstance(q, Flow) else None
    frame, val = (flow.frame, flow.val) if flow else (s.frame, q)
    at = s.at(frame, val)
    rec = fields_of(c, at, args[1:], val) if len(args) > 1 else val
    parts = _parts(c, at, rec)
    if parts is None:
        text = F.to_json(F.struct(rec.col.alias("value")), {"ignoreNullFields": "false"})
    else:
        text = F.to_json(F.struct(*[column(c, at, x).alias(n) for n, x in parts.items() if not n.startswith("_")]), {"ignoreNullFields": "false"})
    out = Val("str", text, tag="json")
    return Flow(frame, out) if flow else out


@rule("dataframe")
def dataframe(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """A table of the fields, or of what is shown: fields of records and entities inside become columns of their own, and
    many values are tables inside."""
    if len(args) > 1:
        from .navigate import select

        q = select(c, s, args)
    else:
        q = c.compile(args[0], s)
    v, frame = (q.val, q.frame) if isinstance(q, Flow) else (q, s.frame)
    if isinstance(q, Flow) and q.span is not None or _parts(c, s.at(frame, v), v) is None:
        return q
    if isinstance(q, Flow):
        q = settled(q)
        frame = q.frame
    flat = Val("record", fields=_flat(c, s.at(frame, v), v), base=v if v.base is None else v.base, tag=v.tag, optional=v.optional)
    return replace(q, val=flat) if isinstance(q, Flow) else flat


def _flat(c: Compiler, s: Scope, v: Val) -> dict[str, Val | Flow]:
    """The fields of a value and of the single values in it; a name that is taken gets a number."""
    out: dict[str, Val | Flow] = {}

    def add(name: str, x: Val | Flow) -> None:
        out[name if name not in out else f"{name}_{len(out) + 1}"] = x

    for n, x in _parts(c, s, v).items():
        x = c.hung(x, s)
        if isinstance(x, Flow):
            inner = s.at(x.frame, x.val)
            if x.span is None and _parts(c, inner, x.val) is not None:
                x = settled(x)
                inner = s.at(x.frame, x.val)
                x = replace(x, val=Val("record", fields=_flat(c, inner, x.val), base=x.val if x.val.base is None else x.val.base, tag=x.val.tag))
            add(n, x)
        elif _parts(c, s, x) is not None:
            for m, y in _flat(c, s, x).items():
                add(m, replace(y, col=F.when(x.present(), y.col), optional=True) if isinstance(y, Val) and x.optional and y.col is not None else y)
        else:
            add(n, x)
    return out


def html(df: DataFrame, rows: int = 20) -> str:
    """A table of HTML with the first rows; lists of records are tables inside, of as many rows as the root of that."""
    return _table(df.columns, [list(r) for r in df.limit(rows + 1).collect()], rows)


def _table(names: list[str], values: list[list], most: int) -> str:
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join(f"<tr><th>{i}</th>{''.join(f'<td>{_cell(v, most)}</td>' for v in row)}</tr>" for i, row in enumerate(values[:most], 1))
    more = f"<tr><th>&vellip;</th>{'<td>&vellip;</td>' * len(names)}</tr>" if len(values) > most else ""
    return f'<table class="dataframe"><tr><th></th>{head}</tr>{body}{more}</table>'


def _cell(value: object, most: int) -> str:
    if isinstance(value, list) and value and isinstance(value[0], Row):
        return _table(list(value[0].__fields__), [list(r) for r in value], 1 + round(math.sqrt(most)))
    return "" if value is None else escape(str(value))


__all__ = ["column", "html", "shown", "table"]
