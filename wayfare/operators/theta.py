"""Aggregates over links by conditions, without the pairs: where the condition is equalities and one comparison of order
between something of the left value and something of the right one, both sides are sorted together and aggregated once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..compiler import Compiler, Scope
from ..flow import Flow, Frame, Order, Span, Val, both, fresh
from ..syntax import Call, Compose, Named
from .windows import over, running

_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
_PLAIN = {"count", "exists", "sum", "max", "min", "mean", "any", "all"}


@dataclass
class Theta:
    """A link's two sides and its condition: ``right`` is the frame of its values by themselves."""

    c: Compiler
    s: Scope
    right: Frame
    val: Val
    tree: object

    def aggregate(self, make: Column, x: Column, name: str) -> Column | None:
        """An aggregate, of a column ``x``, over the linked values' x, as a column of the frame above; none where it takes
        the pairs."""
        above = self.s.frame
        found = self._sides() if name in _PLAIN and above.rid else None
        if found is None:
            return None
        equal, order, op = found
        keys, v, side, item = [fresh("k") for _ in equal], fresh("o"), fresh("side"), "x"
        rids = {r: fresh("key" if r.startswith("key_") else "k") for r in above.rid}
        lefts, rights = [[a for a, _ in equal], [b for _, b in equal]]
        if order is not None:
            keys, lefts, rights = [*keys, v], [*lefts, order[0]], [*rights, order[1]]
        mine = above.df.select(*[F.col(r).alias(n) for r, n in rids.items()], *[a.alias(k) for a, k in zip(lefts, keys, strict=True)], F.lit(True).alias(side))
        try:
            others = self.right.df.select(*[b.alias(k) for b, k in zip(rights, keys, strict=True)], x.alias(item), F.lit(False).alias(side))
        except AnalysisException:  # what is aggregated needs more than the right side
            return None
        if self.right.attached or any(mine.schema[k].dataType != others.schema[k].dataType for k in keys):
            return None
        there = both(tuple(F.col(k).isNotNull() for k in keys))
        rows = mine.filter(there).unionByName(others.filter(there), allowMissingColumns=True)
        ends = keys[: len(equal)]
        # the greatest first where the right value is to be greater; of equals the left first where they don't count
        orders = [] if order is None else [Order(F.col(v), desc=op in ("<", "<=")), Order(F.col(side), desc=op in ("<", ">"))]
        span = Span("and_around" if order is None else "and_before", tuple(F.col(k) for k in ends))
        flow = Flow(Frame(rows, None, [], [], orders), self.val, span=span)
        col = running(flow, make, name)
        out, value = over(flow, make) if col is None else col, fresh("c")
        df = flow.frame.df.filter(F.col(side)).select(*rids.values(), out.alias(value))
        child = Frame(df, above, list(rids.items()))
        return child.aggregate(lambda k: F.max(value), ())

    def _sides(self) -> tuple[list[tuple[Column, Column]], tuple[Column, Column] | None, str] | None:
        """Pairs of columns that are to be equal, the pair that is compared, and how; none if the condition is another."""
        s, equal, orders, unlike = self.s, [], [], []
        for part in _conjuncts(self.tree):
            if not isinstance(part, Call) or part.name not in _TURNED or len(part.args) != 2:
                return None
            (a, b), op = part.args, part.name
            if (_named(a), _named(b)) == ({"right"}, {"left"}):
                a, b, op = b, a, _TURNED[op]
            if (_named(a), _named(b)) != ({"left"}, {"right"}):
                return None
            x = self.c.compile(a, s.at(s.frame, Val("record", fields={"left": s.focus})))
            y = self.c.compile(b, s.at(self.right, Val("record", fields={"right": self.val})))
            if isinstance(x, Flow) or isinstance(y, Flow) or "record" in (x.kind, y.kind) or "null" in (x.kind, y.kind):
                return None
            if op == "==":
                equal += zip(x.keys(), y.keys(), strict=True)
            elif op == "!=":
                unlike.append((x, a, b))
            else:
                orders.append((x.col, y.col, op, _swapped(a) == b))
        if len(orders) > 1 or not (equal or orders):
            return None
        # values of one class that differ in what is compared are not the same: their ids differ
        apart = bool(orders) and orders[0][2] in ("<", ">") and orders[0][3] and self.val.cls is not None and self.val.cls is s.focus.cls
        for x, a, b in unlike:
            same = x.ids == s.focus.ids if x.cls else str(x.col) == str(self.c.identity(s.focus).col)
            if not (apart and same and _swapped(a) == b):
                return None
        return equal, orders[0][:2] if orders else None, orders[0][2] if orders else ""


def _conjuncts(tree: object) -> list:
    return [y for x in tree.args for y in _conjuncts(x)] if isinstance(tree, Call) and tree.name == "&" else [tree]


def _named(tree: object) -> set[str]:
    """Which of ``left`` and ``right`` a tree names."""
    if isinstance(tree, Call):
        return {tree.name} & {"left", "right"} if not tree.args else set().union(*map(_named, tree.args))
    if isinstance(tree, Compose):
        return _named(tree.first) | _named(tree.then)
    return _named(tree.query) if isinstance(tree, Named) else set()


def _swapped(tree: object) -> object:
    """The tree with ``right`` for ``left``."""
    if isinstance(tree, Call):
        return Call("right" if tree.name == "left" and not tree.args else tree.name, tuple(map(_swapped, tree.args)))
    if isinstance(tree, Compose):
        return Compose(_swapped(tree.first), _swapped(tree.then))
    return Named(tree.name, _swapped(tree.query)) if isinstance(tree, Named) else tree
