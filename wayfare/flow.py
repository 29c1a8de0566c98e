"""What queries become: frames of rows, and values and flows over them.

A frame is a DataFrame with one row for each input of an expression.  A singular expression is a column of it (Val);
links add joins to it.  A plural expression is a child frame (Flow), whose rows point to those of the frame above by
equal columns.  An aggregate groups the child by these columns and joins the result; all aggregates over one child
share one grouping, which is done only when the frame's rows are asked for."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Class
from .syntax import QueryError

_numbers = itertools.count(1)


def fresh(stem: str = "c") -> str:
    return f"{stem}_{next(_numbers)}"


@dataclass
class Val:
    """One value, or none if ``optional``, for each row of a frame.

    An entity has a class, the columns of its key, and its other columns once they are joined; a record has fields and
    the value it was selected from."""

    kind: str
    col: Column | None = None
    optional: bool = False
    tag: str | None = None
    cls: Class | None = None
    ids: tuple[str, ...] = ()
    fields: dict[str, Any] | None = None
    base: Val | None = None
    defs: dict[str, Any] = field(default_factory=dict)
    desc: bool = False
    nulls_last: bool = False
    const: bool = False

    def named(self, tag: str | None) -> Val:
        return replace(self, tag=tag or self.tag)

    def keys(self) -> list[Column]:
        """Columns that tell values apart: an entity's key, a record's base or else its singular fields."""
        if self.cls:
            return [F.col(i) for i in self.ids]
        if self.kind == "record":
            return self.base.keys() if self.base is not None else [k for v in self.fields.values() if isinstance(v, Val) for k in v.keys()]
        return [self.col]

    def present(self) -> Column:
        if self.kind == "record":
            return self.base.present() if self.base is not None else F.lit(True)
        return F.col(self.ids[0]).isNotNull() if self.cls else self.col.isNotNull()


@dataclass
class Span:
    """Which neighbours a flow has instead of one value: rows of the same frame."""

    name: str
    keys: tuple = ()


@dataclass
class Flow:
    """Any number of values for each row of the frame above: rows of ``frame`` for which ``cond`` holds."""

    frame: Frame
    val: Val
    cond: tuple[Column, ...] = ()
    span: Span | None = None

    def named(self, tag: str | None) -> Flow:
        return replace(self, val=self.val.named(tag))


def both(conds: tuple[Column, ...]) -> Column | None:
    out = None
    for c in conds:
        out = c if out is None else out & c
    return out


@dataclass
class Order:
    col: Column
    desc: bool = False
    nulls_last: bool = False

    def sort(self, flip: bool = False) -> Column:
        if self.desc != flip:
            return self.col.desc_nulls_last() if self.nulls_last != flip else self.col.desc_nulls_first()
        return self.col.asc_nulls_last() if self.nulls_last != flip else self.col.asc_nulls_first()


@dataclass
class Run:
    """A running aggregate over parts of a frame that follow one another: make: of one part; again: of several parts'
    results; within: over the row's own part; join: of both; before: whether the parts before the row count."""

    name: str
    part: str
    make: Column
    again: Callable[[Column], Column]
    within: Column
    join: Callable[[Column, Column], Column]
    before: bool


class Frame:
    """rid: columns that tell its rows apart; link: pairs of (column above, own column); order: of the rows under one
    row above; attached: its rows hold the columns of the frame above; source: what it takes its rows from when they are
    asked for; alone: rows and link before the frame above was attached, and the rows just after; theta: the condition by
    which its rows are linked to those above."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], up: Frame | None, link: list[tuple[str, str]] | None = None, rid: list[str] | None = None, order: list[Order] | None = None, *, attached: bool = False, joined: dict | None = None):
        self._df, self.up, self.link, self.rid, self.order = df, up, list(link or []), list(rid or []), list(order or [])
        self.attached, self.joined = attached, dict(joined or {})
        self.pending: list[tuple[Frame, list]] = []
        self.whole: list[list[tuple[str, Column]]] = []
        self.runs: list[Run] = []
        self.memo: dict[Any, Any] = {}
        self.explicit = False
        self.origin: Frame | None = None
        self.source: Frame | None = None
        self.alone: tuple[DataFrame, list[tuple[str, str]], DataFrame] | None = None
        self.theta: Any = None

    @property
    def df(self) -> DataFrame:
        if callable(self._df):  # rows that nobody has asked for yet
            self._df = self._df()
            if self.source is not None:  # which may have got columns in the meantime
                self.attached, self.link, self.joined = self.source.attached, list(self.source.link), dict(self.source.joined)
        while self.pending:
            child, aggs = self.pending.pop(0)
            self._df = self._joined(self._df, child.aggregated(aggs), [(a, b) for a, b in child.link])
        while self.whole:
            level = self.whole.pop(0)
            self._df = self._df.crossJoin(F.broadcast(self._df.agg(*[c.alias(n) for n, c in level])))  # one row
        if self.runs:
            runs, self.runs = self.runs, []
            self._df = self._running(self._df, runs)
        return self._df

    @staticmethod
    def _running(df: DataFrame, runs: list[Run]) -> DataFrame:
        """Adds running aggregates: those within a row's part by a window, and those of the parts before or after it, of
        which there are few, sent to the rows."""
        part = runs[0].part
        totals = df.groupBy(part).agg(*[r.make.alias(r.name) for r in runs])
        every = Window.orderBy(part)
        sides = {True: every.rowsBetween(Window.unboundedPreceding, -1), False: every.rowsBetween(1, Window.unboundedFollowing)}
        beside = {r.name: fresh("w") for r in runs}
        key = fresh("part")
        rest = totals.select(F.col(part).alias(key), *[r.again(F.col(r.name)).over(sides[r.before]).alias(beside[r.name]) for r in runs])
        df = df.join(F.broadcast(rest), F.col(part) == F.col(key)).drop(key)
        return df.select("*", *[r.join(r.within, F.col(beside[r.name])).alias(r.name) for r in runs]).drop(*beside.values())

    def total(self, col: Column) -> Column:
        """An aggregate over all rows, beside each of them; all that don't need one another are made at once."""
        name, text = fresh("w"), str(col)
        if any(r.name in text for r in self.runs):
            _ = self.df  # what it needs is made first
        level = max((i + 1 for i, made in enumerate(self.whole) if any(n in text for n, _ in made)), default=0)
        if level == len(self.whole):
            self.whole.append([])
        self.whole[level].append((name, col))
        return F.col(name)

    @property
    def waiting(self) -> bool:
        return callable(self._df)

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df

    @staticmethod
    def _joined(above: DataFrame, grouped: DataFrame, link: list[tuple[str, str]]) -> DataFrame:
        if not link:
            return above.crossJoin(F.broadcast(grouped))  # one row
        names = {b: fresh("k") for _, b in link}
        grouped = grouped.select(*[F.col(b).alias(n) for b, n in names.items()], *[c for c in grouped.columns if c not in names])
        cond = both(tuple(F.col(a).eqNullSafe(F.col(names[b])) if b.startswith("key_") else F.col(a) == F.col(names[b]) for a, b in link))
        return above.join(grouped, cond, "left").drop(*names.values())

    def aggregated(self, aggs: list[tuple[str, Callable, Column | None]], *, every: bool = False) -> DataFrame:
        """One row for each row above that has children, or that has some for which conditions hold unless ``every``;
        aggs: (name, function of a condition, condition)."""
        conds = [c for *_, c in aggs]
        texts = {str(c) for c in conds}
        df = self.df
        if every:
            made = [f(c).alias(n) for n, f, c in aggs]
        elif all(k is not None for k in conds) and len(texts) == 1:
            df, made = df.filter(conds[0]), [f(None).alias(n) for n, f, _ in aggs]
        else:
            if conds and all(k is not None for k in conds):
                some = conds[0]
                for c in conds[1:]:
                    some = some | c
                df = df.filter(some)
            made = [f(c).alias(n) for n, f, c in aggs]
        own = self.own()
        if not made:
            return df.select(*own).distinct()
        return df.groupBy(*own).agg(*made) if own else df.agg(*made)

    def aggregate(self, make: Callable[[Column | None], Column], cond: tuple[Column, ...], name: str | None = None) -> Column:
        """Registers an aggregate over this frame's rows with the frame above; gives its column there."""
        if self.origin is not None and self.up.waiting:  # the rows above are yet to be chosen from those of the origin
            return self.origin.aggregate(make, cond, name)
        name = name or fresh("a")
        for child, aggs in self.up.pending:
            if child is self:
                aggs.append((name, make, both(cond)))
                break
        else:
            self.up.pending.append((self, [(name, make, both(cond))]))
        return F.col(name)

    def under(self, up: Frame) -> Frame:
        """The same rows under a frame that was derived from the one above."""
        out = Frame(lambda: self.df, up, self.link, self.rid, self.order, attached=self.attached, joined=self.joined)
        out.explicit, out.origin = self.explicit, self
        return out

    def derive(self, df: DataFrame | Callable[[], DataFrame], **changes: Any) -> Frame:
        """A frame with other rows or another order but the same columns."""
        out = Frame(df, self.up, self.link, self.rid, self.order, attached=self.attached, joined=self.joined)
        out.explicit = self.explicit
        out.source = self if callable(df) else None
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def attach(self) -> Frame:
        """Joins the columns of the frame above, so that names bound there can be used here."""
        own = self.df
        if not self.attached and self.up is not None:
            above, link = self.up.df, list(self.link)
            if not self.link:
                self.df = F.broadcast(above).crossJoin(own) if self.up.up is None and not self.up.rid else above.crossJoin(own)
            else:
                self.df = above.join(own, both(tuple(F.col(a).eqNullSafe(F.col(b)) if b.startswith("key_") else F.col(a) == F.col(b) for a, b in self.link)))
            if self.link and not set(self.up.rid) <= {a for a, _ in self.link}:
                self.link = [(r, r) for r in self.up.rid]  # rows above that share a link are told apart now
            self.attached, self.alone = True, (own, link, self.df)
        return self

    def reach(self, target: Frame) -> None:
        """Makes the columns of a frame further up available."""
        f, chain = self, []
        while f is not target:
            if f is None:
                raise QueryError("a name is used outside the query that it is bound in")
            chain.append(f)
            f = f.up
        for f in reversed(chain):
            f.attach()

    def join_entity(self, val: Val) -> dict[str, str]:
        """Names of the entity's columns here, joined once."""
        at = (val.cls.name, val.ids)
        if at not in self.joined:
            p = fresh(val.cls.name)
            cols = {c: f"{p}_{c}" for c in val.cls.df.columns}
            right = val.cls.df.select(*[F.col(c).alias(n) for c, n in cols.items()])
            cond = both(tuple(F.col(i) == F.col(cols[k]) for i, k in zip(val.ids, val.cls.key, strict=True)))
            self.df = self.df.join(right, cond, "left")
            self.joined[at] = cols
        return self.joined[at]

    def orders(self) -> list[Order]:
        """A total order of the rows under one row above."""
        return [*self.order, *[Order(F.col(r)) for r in self.rid]]

    def own(self) -> list[str]:
        return list(dict.fromkeys(b for _, b in self.link))

    def numbered(self, *, flip: bool = False, orders: list[Order] | None = None) -> tuple[DataFrame, str]:
        """Rows with their number under the row above."""
        n = fresh("n")
        by = [o.sort(flip) for o in (orders or self.orders())] or [F.lit(0)]
        return self.df.withColumn(n, F.row_number().over(Window.partitionBy(*self.own()).orderBy(*by))), n


def settled(flow: Flow) -> Flow:
    """The flow with its conditions applied to the rows."""
    if not flow.cond:
        return flow
    return Flow(flow.frame.derive(lambda: flow.frame.df.filter(both(flow.cond))), flow.val)


def scan(cls: Class, up: Frame) -> Flow:
    p = fresh(cls.name)
    cols = {c: f"{p}_{c}" for c in cls.df.columns}
    ids = tuple(cols[k] for k in cls.key)
    frame = Frame(cls.df.select(*[F.col(c).alias(n) for c, n in cols.items()]), up, [], list(ids), joined={(cls.name, ids): cols})
    return Flow(frame, Val("entity", cls=cls, ids=ids, tag=cls.name))


def flatten(outer: Flow, inner: Flow) -> Flow:
    """The flow of all inner values under each row above the outer flow."""
    a, b = outer.frame, inner.frame
    above = a.df.filter(both(outer.cond)) if outer.cond else a.df
    if b.attached:
        df = b.df.filter(both(outer.cond)) if outer.cond else b.df
    elif not b.link:
        df = above.crossJoin(b.df)
    else:
        df = above.join(b.df, both(tuple(F.col(x).eqNullSafe(F.col(y)) if y.startswith("key_") else F.col(x) == F.col(y) for x, y in b.link)))
    rid = list(dict.fromkeys([*a.rid, *b.rid]))
    frame = Frame(df, a.up, a.link, rid, [*a.orders(), *b.order], attached=a.attached, joined={**a.joined, **b.joined})
    frame.explicit = a.explicit or b.explicit
    return Flow(frame, inner.val, inner.cond)
