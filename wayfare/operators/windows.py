"""Neighbours: the values of the flow around the one in focus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from ..compiler import Compiler, Scope, rule
from ..flow import Flow, Frame, Order, Run, Span, fresh
from ..syntax import QueryError

#: Frames of up to so many bytes, as read, are ordered as a whole by one task; larger ones in so many parts at most.
WINDOW_BYTES, MOST_PARTS = 64 << 20, 256
#: Rows of a group that get its list together.
CHUNK_ROWS = 1000
SPANS = {"before", "and_before", "after", "and_after", "around", "and_around"}


@rule(*sorted(SPANS))
def neighbours(c: Compiler, s: Scope, args: tuple, name: str) -> Flow:
    """Rows before, after or around this one, with it (and_) or without; with keys, those with equal keys.

    In the second dialect before and around include the row itself."""
    if c.dialect == "v2" and name in ("before", "around"):
        name = f"and_{name}"
    keys = []
    for a in args:
        v = c.val(a, s, name)
        keys += v.keys()
    span = Span(name, tuple(keys))
    span.border = s.border
    return Flow(s.frame, s.focus, span=span)


def _borders(f: Frame, border: Frame | None) -> tuple[list[str], list[Order]]:
    """Columns that tell apart the rows of the border, and the order of all rows under one of them."""
    chain, g = [], f
    while g is not border and g is not None:
        chain.append(g)
        g = g.up
    if g is None and border is not None:
        raise QueryError("neighbours are asked for outside their query")
    for g in reversed(chain[:-1]):
        g.attach()
    top = chain[-1] if chain else f
    orders = [o for g in reversed(chain) for o in g.orders()]
    return top.own(), orders


def kept(flow: Flow, col: Column) -> Column:
    """A column computed over a window, kept with the frame's rows, so that conditions can use it."""
    name = fresh("w")
    flow.frame.df = flow.frame.df.withColumn(name, col)
    return F.col(name)


def window(flow: Flow) -> WindowSpec:
    """The window of a span; leaving out the row itself is left to the caller."""
    span = flow.span
    own, orders = _borders(flow.frame, getattr(span, "border", None))
    w = Window.partitionBy(*own, *span.keys)
    if span.name.endswith("around"):
        return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _side_of(w, orders, span.name)


def _side_of(w: WindowSpec, orders: list[Order], name: str) -> WindowSpec:
    """The rows on one side of each row, the nearest last.

    What comes after a row is what comes before it in the opposite order: a frame that ends with its row grows by one row
    at a time, one that starts with it is gone through anew for each row."""
    w = w.orderBy(*[o.sort(flip=name.endswith("after")) for o in orders])
    return w.rowsBetween(Window.unboundedPreceding, 0 if name.startswith("and_") else -1)


def over(flow: Flow, col: Column) -> Column:
    """An aggregate over a span, kept with the frame's rows.

    Over all rows of the frame it is one number: aggregated by itself and sent to the rows, not a window, which would
    bring them to one task."""
    own, _ = _borders(flow.frame, getattr(flow.span, "border", None))
    if own or flow.span.keys or not flow.span.name.endswith("around"):
        return kept(flow, col.over(window(flow)))
    return flow.frame.total(col)


def parts(flow: Flow, orders: list[Order]) -> str | None:
    """A column that cuts the frame's rows into parts which follow one another in the order, of about equal size.

    The cuts are quantiles of the first thing ordered by, asked for by a query of its own; they are constants of the plan,
    so the parts are the same whenever they are computed.  None for frames of up to WINDOW_BYTES, and for what is ordered
    by texts first."""
    f, key = flow.frame, ("parts", id(getattr(flow.span, "border", None)))
    if key in f.memo:
        return f.memo[key][0]
    name, first = None, orders[0] if orders else None
    if first is not None and _read_bytes(f) > WINDOW_BYTES:
        kind = f.df.select(first.col.alias("o")).schema["o"].dataType
        number = first.col.cast("double") if isinstance(kind, NumericType) else F.unix_date(first.col).cast("double") if isinstance(kind, DateType) else F.unix_micros(first.col).cast("double") if isinstance(kind, TimestampType) else None
        if number is not None:
            n = max(2, min(MOST_PARTS, int(f.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
            cuts = f.df.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 10_000).alias("c")).first().c or []
            cuts = sorted(set(cuts))
            at = _side(number, cuts, 0)
            at = F.lit(len(cuts)) - at if first.desc else at
            name = fresh("part")
            f.df = f.df.withColumn(name, F.when(number.isNull(), F.lit(len(cuts) + 1 if first.nulls_last else -1)).otherwise(at))
    f.memo[key] = (name, flow.span)
    return name


def _read_bytes(f: Frame) -> int:
    """What a frame reads, by the optimizer's estimate of its tables; tables of an unknown size count as large."""
    leaves = f.df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _side(number: Column, cuts: list[float], low: int) -> Column:
    """How many cuts lie below a number: a search by halves, written out."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(number <= cuts[mid], _side(number, cuts[:mid], low)).otherwise(_side(number, cuts[mid + 1 :], low + mid + 1))


#: How aggregates of parts make those of the whole, and two of them one.
_AGAIN: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "count": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "any": (F.bool_or, lambda a, b: F.coalesce(a | b, a, b)),
    "all": (F.bool_and, lambda a, b: F.coalesce(a & b, a, b)),
}
_AGAIN["exists"] = _AGAIN["count"]


def running(flow: Flow, make: Column, name: str) -> Column | None:
    """An aggregate over the rows before or after each one, of a large frame as a whole, without bringing all rows to one
    task; none where a window does."""
    own, orders = _borders(flow.frame, getattr(flow.span, "border", None))
    if own or flow.span.keys or flow.span.name.endswith("around") or name not in _AGAIN:
        return None
    part = parts(flow, orders)
    if part is None:
        return None
    if any(r.name in str(make) for r in flow.frame.runs):
        _ = flow.frame.df  # what it needs is made first
    again, join = _AGAIN[name]
    back = flow.span.name.endswith("before")
    w = _side_of(Window.partitionBy(part), orders, flow.span.name)
    run = Run(fresh("w"), part, make, again, make.over(w), join, back)
    flow.frame.runs.append(run)
    return F.col(run.name)


def neighbour(flow: Flow, col: Column, *, nearest: bool, skip: bool) -> Column:
    """The nearest or farthest value on one side of each row, the missing ones skipped or not; of a large frame as a whole
    in parts."""
    from .navigate import ranked

    own, orders = _borders(flow.frame, getattr(flow.span, "border", None))
    take = F.last if nearest else F.first
    part = None if own or flow.span.keys else parts(flow, orders)
    back = flow.span.name.endswith("before")
    rank = ranked(flow.frame.df, orders, flip=back == nearest) if part else None
    if rank is None:
        return kept(flow, take(col, ignorenulls=skip).over(window(flow)))
    pick_one, key = rank
    item = F.when(col.isNotNull(), F.struct(col.alias("v"))) if skip else F.struct(col.alias("v"))
    again = F.last if back == nearest else F.first  # of the parts on that side, in their order
    w = _side_of(Window.partitionBy(part), orders, flow.span.name)
    run = Run(
        fresh("w"), part, pick_one(item, F.when(item.isNotNull(), key)), lambda x: again(x, ignorenulls=True), take(item, ignorenulls=True).over(w),
        lambda a, b: F.coalesce(a, b) if nearest else F.coalesce(b, a), back,
    )
    flow.frame.runs.append(run)
    return kept(flow, F.col(run.name)["v"])


def listed(flow: Flow, item: Column, n: Column) -> Column:
    """Lists ``n`` and ``v`` of a group's items (n, v) by n, beside each of its rows, whose number in the group is n.

    A list is made once for its group and sent to the group's rows in lots of CHUNK_ROWS, which are dealt over all tasks:
    what is made of it for each row, work with the square of the group's size, is not left to one task."""
    own, _ = _borders(flow.frame, getattr(flow.span, "border", None))
    group, lot, items = fresh("g"), fresh("lot"), fresh("w")
    df = flow.frame.df
    by = [*[F.col(x) for x in own], *flow.span.keys]
    df = df.withColumn(group, F.struct(*by) if by else F.lit(0)).withColumn(lot, F.floor((n - 1) / CHUNK_ROWS).cast("int"))
    lists = df.groupBy(F.col(group).alias("g")).agg(F.array_sort(F.collect_list(item)).alias("x"), F.max(lot).alias("most"))
    lists = lists.select("g", F.struct(F.col("x.n").alias("n"), F.col("x.v").alias("v")).alias(items), F.explode(F.sequence(F.lit(0), "most")).alias("l"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df, lists = df.repartition(tasks, group, lot), lists.repartition(tasks, "g", "l").hint("merge")
    flow.frame.df = df.join(lists, (F.col(group) == F.col("g")) & (F.col(lot) == F.col("l"))).drop("g", "l", group, lot)
    return F.col(items)


def place(flow: Flow) -> Column:
    """The number of each row among those of its span, in their order."""
    own, orders = _borders(flow.frame, getattr(flow.span, "border", None))
    by = [o.sort() for o in orders] or [F.lit(0)]
    return kept(flow, F.row_number().over(Window.partitionBy(*own, *flow.span.keys).orderBy(*by)))
