"""Compiles trees of queries: names, composition, lifting of scalar functions, and the table of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from .catalog import Arrow, Catalog
from .flow import Flow, Frame, Order, Val, both, flatten, fresh, scan, settled
from .functions.scalars import SCALARS, contains, literal
from .syntax import Call, Compose, Lit, Named, QueryError, Regex

CASTS = {"int": "bigint", "money": "decimal(18,2)", "date": "date"}
#: name -> rule(compiler, scope, args) for everything that is no scalar function.
RULES: dict[str, Callable[..., Val | Flow]] = {}


def rule(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names:
            RULES[n] = f if len(names) == 1 else (lambda c, s, a, n=n, f=f: f(c, s, a, n))
        return f

    return add


@dataclass
class Bound:
    """A name bound to a value of a frame at or above the place where it is used."""

    frame: Frame
    value: Val | Flow


@dataclass
class Scope:
    frame: Frame
    focus: Val
    env: dict[str, Bound] = field(default_factory=dict)
    border: Frame | None = None  # rows count as neighbours within one row of this frame

    def at(self, frame: Frame, focus: Val) -> Scope:
        return Scope(frame, focus, self.env, self.border)


class Compiler:
    def __init__(self, catalog: Catalog, *, dialect: str = "v1"):
        self.catalog, self.dialect = catalog, dialect
        one = catalog.spark.range(1).select(F.lit(1).alias("unit"))
        self.root = Frame(one, None)
        self.top = Scope(self.root, Val("unit", F.lit(1)), border=self.root)

    # -- trees

    def compile(self, tree: Any, scope: Scope) -> Val | Flow:
        key = None
        try:
            key = (tree, id(scope.focus), id(scope.env), id(scope.border))
            if key in scope.frame.memo:
                return scope.frame.memo[key][0]
        except TypeError:
            key = None  # a tree with values that can't be hashed
        out = self._compile(tree, scope)
        if key is not None:
            scope.frame.memo[key] = (out, scope.focus, scope.env)  # kept, so that ids stay theirs
        return out

    def _compile(self, tree: Any, scope: Scope) -> Val | Flow:
        if isinstance(tree, (Val, Flow)):
            return tree
        if isinstance(tree, Lit):
            return literal(tree.value)
        if isinstance(tree, Named):
            return self.compile(tree.query, scope).named(tree.name)
        if isinstance(tree, Compose):
            return self.compose(self.compile(tree.first, scope), tree.then, scope)
        if isinstance(tree, Call):
            if not tree.args and (found := self.name(tree.name, scope)) is not None:
                return found
            if tree.name in RULES:
                return RULES[tree.name](self, scope, tree.args)
            if tree.name in SCALARS:
                return self.scalar(tree.name, tree.args, scope)
            if tree.args and self.has(tree.name, scope):
                raise QueryError(f"{tree.name} takes no arguments")
        raise QueryError(f"{tree} is not known here")

    def compose(self, first: Val | Flow, then: Any, scope: Scope) -> Val | Flow:
        if isinstance(first, Val):
            out = self.compile(then, scope.at(scope.frame, first))
            if isinstance(out, Val):
                if first.optional and out.kind != "null" and not out.optional:
                    if out.cls or out.kind == "record":
                        out = replace(out, optional=True)
                    else:
                        out = replace(out, optional=True, col=F.when(first.present(), out.col))
                return out
            return replace(out, cond=(*out.cond, first.present())) if first.optional and out.frame.attached else out
        inner = self.compile(then, scope.at(first.frame, first.val))
        if isinstance(inner, Val):
            return replace(first, val=inner, cond=(*first.cond, inner.present()) if inner.optional else first.cond)
        if first.span is not None or inner.frame is first.frame:
            raise QueryError("neighbours can't lead to many values each")
        return flatten(first, inner)

    # -- names

    def has(self, name: str, scope: Scope) -> bool:
        return self.name(name, scope) is not None

    def name(self, name: str, scope: Scope) -> Val | Flow | None:
        if name in scope.env:
            b = scope.env[name]
            if isinstance(b.value, Call):  # many values given as a parameter
                return self.compile(b.value, scope).named(name)
            if b.frame is not scope.frame and not (isinstance(b.value, Val) and b.value.const):
                scope.frame.reach(b.frame)
            if isinstance(b.value, Flow) and b.frame is not scope.frame:
                raise QueryError(f"{name} has many values; use it where it is bound")
            return b.value.named(name)
        found = self.member(name, scope)
        if found is not None:
            return found
        if name in self.catalog.classes and scope.focus.kind == "unit":
            return scan(self.catalog[name], scope.frame)
        return None

    def member(self, name: str, scope: Scope) -> Val | Flow | None:
        """A defined name, a field, or an arrow of what is in focus."""
        focus = scope.focus
        if name in focus.defs:
            tree, outer, env, border = focus.defs[name]
            return self.compile(tree, Scope(scope.frame, outer, env, border)).named(name)
        if focus.kind == "record":
            if name in focus.fields:
                return self.hung(focus.fields[name], scope).named(name)
            base = focus.base
            if base is not None and name == base.tag:
                return base
            return self.member(name, scope.at(scope.frame, base)) if base is not None and name in base.defs else None
        if focus.cls:
            if name in focus.cls.arrows:
                return self.follow(focus, focus.cls.arrows[name], scope.frame)
            if name == "id":
                return self.identity(focus)
        return None

    def hung(self, value: Val | Flow, scope: Scope) -> Val | Flow:
        """A field's flow under the frame in use, which may have been derived from the one that it was made for."""
        if isinstance(value, Val) or value.span is not None or value.frame.up is scope.frame:
            return value
        key = ("hung", id(value.frame))
        if key not in scope.frame.memo:
            scope.frame.memo[key] = (value.frame.under(scope.frame), value.frame)
        return replace(value, frame=scope.frame.memo[key][0])

    def identity(self, focus: Val) -> Val:
        if len(focus.ids) == 1:
            kind = focus.cls.kind(Arrow("id", focus.cls.key[0]))
            return Val(kind, F.col(focus.ids[0]).cast(CASTS[kind]) if kind in CASTS else F.col(focus.ids[0]), focus.optional, "id")
        return Val("any", F.struct(*[F.col(i).alias(k) for i, k in zip(focus.ids, focus.cls.key, strict=True)]), focus.optional, "id")

    def follow(self, focus: Val, arrow: Arrow, frame: Frame) -> Val | Flow:
        key = ("arrow", focus.cls.name, focus.ids, arrow.name)
        if key not in frame.memo:
            frame.memo[key] = (self._follow(focus, arrow, frame),)
        return frame.memo[key][0]

    def _follow(self, focus: Val, arrow: Arrow, frame: Frame) -> Val | Flow:
        if arrow.column:
            ids = dict(zip(focus.cls.key, focus.ids, strict=True))
            name = ids.get(arrow.column) or frame.join_entity(focus)[arrow.column]
            col, kind = F.col(name), focus.cls.kind(arrow)
            if kind.startswith("many "):  # a list in a column: its elements are the values
                from .operators.ordering import exploded

                return exploded(Scope(frame, focus), F.filter(col, lambda x: x.isNotNull()), kind[5:], arrow.name)
            if kind in CASTS:
                col = col.cast(CASTS[kind])
            return Val(kind, col, focus.optional or arrow.optional, arrow.name)
        ids, target = dict(zip(focus.cls.key, focus.ids, strict=True)), self.catalog[arrow.target]
        if any(a not in ids for a, _ in arrow.on):
            ids = {**frame.join_entity(focus), **ids}
        if not arrow.plural:
            to = {b: ids[a] for a, b in arrow.on}
            return Val("entity", cls=target, ids=tuple(to[k] for k in target.key), optional=focus.optional or arrow.optional, tag=arrow.name)
        flow = scan(target, frame)
        cols = flow.frame.joined[(target.name, flow.val.ids)]
        flow.frame.link = [(ids[a], cols[b]) for a, b in arrow.on]
        return Flow(flow.frame, flow.val.named(arrow.name))

    # -- functions

    def scalar(self, name: str, args: tuple, scope: Scope) -> Val | Flow:
        """Applies a function to all combinations of its arguments' values, the first argument's outermost."""
        if name == "contains" and len(args) == 2 and isinstance(args[1], Regex):
            return self.lift(lambda a: contains(a, args[1]), args[:1], scope)
        return self.lift(SCALARS[name], args, scope)

    def lift(self, f: Callable[..., Val], args: tuple, scope: Scope) -> Val | Flow:
        values = [self.compile(a, scope) for a in args]
        many = [v for v in values if isinstance(v, Flow)]
        if not many:
            out = f(*values)
            return replace(out, const=True) if values and all(v.const for v in values) else out
        if len(many) > 1:
            flow, vals = self.product(many, scope)
            it = iter(vals)
            return self.over(flow, f, [next(it) if isinstance(v, Flow) else v for v in values], scope)
        flow = many[0]
        return self.over(flow, f, [v.val if isinstance(v, Flow) else v for v in values], scope)

    def over(self, flow: Flow, f: Callable[..., Val], values: list[Val], scope: Scope) -> Flow:
        if flow.span is None and any(v is not flow.val and not v.const and v.kind != "null" for v in values):
            flow.frame.reach(scope.frame)  # columns of the row above stand beside those of the flow
        out = f(*values)
        return replace(flow, val=out, cond=(*flow.cond, out.present()) if out.optional else flow.cond)

    def product(self, flows: list[Flow], scope: Scope) -> tuple[Flow, list[Val]]:
        """All combinations of several flows' values under each row above."""
        flows = [self.fresh_copy(settled(f), scope) for f in flows]
        first, vals = flows[0], [flows[0].val]
        for nxt in flows[1:]:
            a, b = first.frame, nxt.frame
            pairs = [(x, y) for (u, x) in a.link for (w, y) in b.link if u == w]
            if {u for u, _ in a.link} != {w for w, _ in b.link} or (a.link and not pairs):
                a.attach()
                b.attach()
                raise QueryError("values that hang on different columns can't be combined")
            df = a.df.join(b.df, both(tuple(F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))) if pairs else a.df.crossJoin(b.df)
            frame = Frame(df, a.up, a.link, [*a.rid, *b.rid], [*a.orders(), *b.order], joined={**a.joined, **b.joined})
            first = Flow(frame, first.val)
            vals.append(nxt.val)
        return first, vals

    def fresh_copy(self, flow: Flow, scope: Scope) -> Flow:
        """The same rows under new column names, so that a flow can be combined with itself."""
        f = flow.frame
        df = f.df
        names = {c: fresh("k" if not c.startswith("key_") else "key") for c in df.columns}
        frame = Frame(df.select(*[F.col(c).alias(n) for c, n in names.items()]), f.up, [(a, names[b]) for a, b in f.link], [names[r] for r in f.rid])
        out = fresh("v")
        val = flow.val
        if val.cls:
            val = replace(val, ids=tuple(names[i] for i in val.ids))
            cols = f.joined.get((val.cls.name, flow.val.ids))
            if cols:
                frame.joined[(val.cls.name, val.ids)] = {c: names[n] for c, n in cols.items()}
        elif val.kind != "record":
            frame.df = df.withColumn(out, val.col).select(*[F.col(c).alias(n) for c, n in names.items()], out)
            val = replace(val, col=F.col(out))
        else:
            raise QueryError("records can't be combined")
        orders = []
        df2 = None
        for o in f.order:
            n = fresh("o")
            df2 = (df2 if df2 is not None else df).withColumn(n, o.col)
            orders.append((n, o))
        if orders:
            extra = {n: fresh("k") for n, _ in orders}
            base = df2.withColumn(out, flow.val.col) if flow.val.cls is None else df2
            frame.df = base.select(*[F.col(c).alias(n) for c, n in names.items()], *[F.col(n).alias(m) for n, m in extra.items()], *([out] if flow.val.cls is None else []))
            frame.order = [Order(F.col(extra[n]), o.desc, o.nulls_last) for n, o in orders]
        return Flow(frame, val)

    # -- help for rules

    def flow(self, tree: Any, scope: Scope, what: str) -> Flow:
        v = self.compile(tree, scope)
        if not isinstance(v, Flow):
            raise QueryError(f"{what} needs many values, and {tree} has one")
        if v.span is not None:
            raise QueryError(f"{what} does not go with neighbours")
        return v

    def val(self, tree: Any, scope: Scope, what: str) -> Val:
        v = self.compile(tree, scope)
        if isinstance(v, Flow):
            raise QueryError(f"{what} needs one value, and {tree} may have many")
        return v

    def tag(self, tree: Any, value: Val | Flow) -> str | None:
        return (value.val if isinstance(value, Flow) else value).tag


def bare(tree: Any) -> str | None:
    """The name in an argument that is to be a name: ``as(size)``."""
    return tree.name if isinstance(tree, Call) and not tree.args else None


def load_rules() -> None:
    from .operators import filters, grouping, hierarchy, navigate, ordering, output, unions, windows  # noqa: F401


__all__ = ["RULES", "Bound", "Compiler", "Scope", "bare", "load_rules", "rule", "settled"]
