"""Filters and tests of membership."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..compiler import Bound, Compiler, Scope, rule
from ..flow import Flow, Val, both, settled
from ..syntax import Call, Compose, Lit, Named, QueryError
from .navigate import bound
from .windows import SPANS


def _mentions(tree: object, names: set[str]) -> bool:
    if isinstance(tree, Call):
        return tree.name in names or any(_mentions(a, names) for a in tree.args)
    if isinstance(tree, Compose):
        return _mentions(tree.first, names) or _mentions(tree.then, names)
    return isinstance(tree, Named) and _mentions(tree.query, names)


def _conjuncts(tree: object) -> list:
    if isinstance(tree, Call) and tree.name == "&":
        return [x for a in tree.args for x in _conjuncts(a)]
    return [tree]


@rule("filter")
def filtered(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """Values for which the condition is true; one that is neither true nor false drops the value.

    Conjuncts that ask whether something exists become semi and anti joins."""
    q = c.compile(args[0], s)
    if isinstance(q, Val):
        p = c.val(args[1], s.at(s.frame, q), "a condition")
        keep = lambda v: replace(v, optional=True, col=F.when(p.col, v.col)) if v.col is not None else None
        out = keep(q)
        if out is None:
            raise QueryError("only plain values and many values can be filtered")
        return out
    if q.cond and _mentions(args[1], SPANS | set(q.val.defs)):
        q = settled(q)
    return _conditions(c, s.at(q.frame, q.val), q, args[1])


def _conditions(c: Compiler, s: Scope, q: Flow, tree: object) -> Flow:
    """The flow with the conjuncts of a condition applied; s: the scope within it, whose names given may have bound."""
    for part in _conjuncts(tree):
        if s.frame is not q.frame:  # the rows left by a test have the columns that names were bound to
            s = Scope(q.frame, s.focus, {n: Bound(q.frame, b.value) if b.frame is s.frame and isinstance(b.value, Val) else b for n, b in s.env.items()}, s.border)
        if isinstance(part, Call) and part.name == "given" and part.args:
            q = _conditions(c, bound(c, s, part.args[1:]), q, part.args[0])
            continue
        negated = isinstance(part, Call) and part.name == "!"
        inner = part.args[0] if negated else part
        known = _known(c, s, q, inner, negated) if isinstance(inner, Call) and q.span is None else None
        if known is not None:
            q = known
            continue
        p = c.compile(part, s)
        if isinstance(p, Flow):
            raise QueryError(f"the condition {part} has many values")
        if p.kind not in ("bool", "null"):
            raise QueryError(f"the condition {part} is neither true nor false")
        q = replace(q, cond=(*q.cond, p.col))
    return q


def _known(c: Compiler, s: Scope, q: Flow, tree: Call, negated: bool) -> Flow | None:
    """The flow with a test of existence or membership as a semi or anti join, where that can be said so."""
    if tree.name in ("exists", "any") and len(tree.args) == 1:
        x = c.compile(tree.args[0], s)
        if isinstance(x, Flow) and x.span is None and x.frame.up is q.frame and x.frame.link:
            return _semi(q, x, (x.val.col,) if tree.name == "any" else (x.val.present(),) if x.val.optional else (), negated)
    if tree.name == "in" and len(tree.args) == 2 and not _listed(s, tree.args[1]):
        x, many = c.compile(tree.args[0], s), c.compile(tree.args[1], s)
        if isinstance(x, Val) and isinstance(many, Flow) and many.span is None and many.frame.up is q.frame and not many.frame.attached and len(many.val.keys()) == 1 and x.kind != "record":
            mine = F.col(x.ids[0]) if x.cls else x.col
            q = replace(q, cond=(*q.cond, mine.isNotNull())) if x.optional else q
            return _semi(q, many, (mine == many.val.keys()[0],), negated)
    return None


def _listed(s: Scope, tree: object) -> bool:
    """Whether the values are given one by one."""
    if isinstance(tree, Call) and tree.name in s.env and isinstance(s.env[tree.name].value, Call):
        tree = s.env[tree.name].value
    return isinstance(tree, Call) and tree.name == "array" and all(isinstance(a, Lit) for a in tree.args)


def _semi(q: Flow, x: Flow, more: tuple[Column, ...], negated: bool) -> Flow:
    """The rows of q for which some row of x fulfils its conditions and some more, which may name columns of both."""
    rows, link, conds = x.frame.df, x.frame.link, (*x.cond, *more)
    if x.frame.attached and x.frame.alone is not None and x.frame.alone[2] is rows:  # nothing was added since: not needed twice
        rows, link, _ = x.frame.alone
    left = q.frame.df.filter(both(q.cond)) if q.cond else q.frame.df
    if x.frame.attached and rows is x.frame.df:
        names = {b: f"{b}_s" for _, b in link}
        rows = rows.filter(both(conds)) if conds else rows
        rows, link, conds = rows.select(*[F.col(b).alias(n) for b, n in names.items()]), [(a, names[b]) for a, b in link], ()
    equal = [F.col(a).eqNullSafe(F.col(b)) if b.startswith("key_") else F.col(a) == F.col(b) for a, b in link]
    clash = set(left.columns) & set(rows.columns)
    if clash:
        raise QueryError(f"{sorted(clash)} stand on both sides of a test")
    on = both((*equal, *conds))
    return Flow(q.frame.derive(left.join(rows, on if on is not None else F.lit(True), "left_anti" if negated else "left_semi")), q.val)


@rule("in")
def member(c: Compiler, s: Scope, args: tuple) -> Val | Flow:
    """Whether the first value is among the second's."""
    x = c.compile(args[0], s)
    if isinstance(x, Flow):  # each of many
        inner = member(c, s.at(x.frame, x.val), (Call("here"), args[1]))
        return replace(x, val=inner)
    tree = args[1]
    if isinstance(tree, Call) and tree.name in s.env and isinstance(s.env[tree.name].value, Call):
        tree = s.env[tree.name].value
    if _listed(s, tree):
        return Val("bool", x.col.isin([a.value for a in tree.args]), x.optional)
    many = c.compile(tree, s)
    if isinstance(many, Val):
        return Val("bool", x.col == many.col, x.optional or many.optional)
    values = many.val.keys()
    if len(values) != 1:
        raise QueryError("in needs simple values")
    mine = F.col(x.ids[0]) if x.cls else x.col
    many.frame.reach(s.frame)
    hit = both((*many.cond, mine == values[0]))
    many.frame.link = many.frame.link or [(r, r) for r in s.frame.rid]
    return Val("bool", F.coalesce(many.frame.aggregate(lambda k: F.max(F.coalesce(k, F.lit(False)) if k is not None else F.lit(True)), (hit,)), F.lit(False)), x.optional)
