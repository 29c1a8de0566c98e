"""Combinators on nested values (JSON read as structs and arrays): each maps a column and a context to a column.

Types are known before anything runs, so mistakes are found when a combinator is applied.  Composition maps over
arrays, joins inner arrays and drops nulls; a null input gives a null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import QueryError


class InputError(QueryError):
    """A combinator is applied to a value of a wrong type."""


class OperandError(QueryError):
    """An operator's operands have wrong types."""


class ContextError(QueryError):
    """A reference to a name that the context does not have."""


@dataclass
class Node:
    col: Column
    type: T.DataType

    @property
    def items(self) -> T.DataType | None:
        return self.type.elementType if isinstance(self.type, T.ArrayType) else None

    @property
    def number(self) -> bool:
        return isinstance(self.type, (T.NumericType, T.NullType))


INT, FLOAT, BOOL, STR = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()


class Combinator:
    def __init__(self, apply: Callable[[Node, dict[str, Node]], Node], text: str, refs: frozenset[str] = frozenset()):
        self.apply, self.text, self.refs = apply, text, refs

    def __repr__(self) -> str:
        return self.text

    def __call__(self, df: DataFrame, ctx: dict[str, Any] | None = None) -> DataFrame:
        """A column ``value`` for each row of ``df``, whose columns are the fields of the input."""
        node = Node(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
        out = self.apply(node, {k: _constant(v) for k, v in (ctx or {}).items()})
        return df.select(out.col.alias("value"))

    def __rshift__(self, other: Any) -> Combinator:
        return Compose(self, other)

    __hash__ = object.__hash__

    def __eq__(self, other: Any) -> Combinator:  # type: ignore[override]
        return _binary("==", self, other)

    def __ne__(self, other: Any) -> Combinator:  # type: ignore[override]
        return _binary("!=", self, other)


def _constant(value: Any) -> Node:
    for t, kind in ((bool, BOOL), (int, INT), (float, FLOAT), (str, STR)):
        if isinstance(value, t):
            return Node(F.lit(value).cast(kind), kind)
    if value is None:
        return Node(F.lit(None), T.NullType())
    if isinstance(value, list):
        nodes = [_constant(v) for v in value]
        return Node(F.array(*[n.col for n in nodes]), T.ArrayType(nodes[0].type if nodes else T.NullType()))
    raise QueryError(f"{value!r} is no value of a document")


def _lift(x: Any) -> Combinator:
    return x if isinstance(x, Combinator) else Const(x)


def Const(value: Any) -> Combinator:
    return Combinator(lambda x, ctx: _constant(value), repr(value))


def Here() -> Combinator:
    return Combinator(lambda x, ctx: x, "Here()")


def Field(name: str) -> Combinator:
    def apply(x: Node, ctx: dict) -> Node:
        if not isinstance(x.type, T.StructType) or name not in x.type.names:
            raise InputError(f"{x.type.simpleString()} has no field {name}")
        return Node(x.col[name], x.type[name].dataType)

    return Combinator(apply, f"Field({name!r})")


def Fields(*names: str) -> tuple[Combinator, ...]:
    return tuple(Field(n) for n in names)


def Ref(name: str) -> Combinator:
    def apply(x: Node, ctx: dict) -> Node:
        if name not in ctx:
            raise ContextError(f"{name} is not bound")
        return ctx[name]

    return Combinator(apply, f"Ref({name!r})", frozenset([name]))


def Refs(*names: str) -> tuple[Combinator, ...]:
    return tuple(Ref(n) for n in names)


def Compose(first: Any, then: Any) -> Combinator:
    f, g = _lift(first), _lift(then)

    def apply(x: Node, ctx: dict) -> Node:
        y = f.apply(x, ctx)
        if y.items is None:
            out = g.apply(y, ctx)
            return Node(F.when(y.col.isNotNull(), out.col), out.type)
        seen: list[T.DataType] = []

        def each(item: Column) -> Column:
            z = g.apply(Node(item, y.items), ctx)
            seen.append(z.type)
            return z.col

        mapped = F.transform(F.filter(y.col, lambda i: i.isNotNull()), each)
        inner = seen[-1]
        if isinstance(inner, T.ArrayType):
            return Node(F.array_compact(F.flatten(F.array_compact(mapped))), inner)
        return Node(F.array_compact(mapped), T.ArrayType(inner))

    return Combinator(apply, f"{f!r} >> {g!r}", f.refs | g.refs)


def Select(**fields: Any) -> Combinator:
    fs = {n: _lift(c) for n, c in sorted(fields.items())}

    def apply(x: Node, ctx: dict) -> Node:
        parts = {n: c.apply(x, ctx) for n, c in fs.items()}
        return Node(F.struct(*[p.col.alias(n) for n, p in parts.items()]), T.StructType([T.StructField(n, p.type) for n, p in parts.items()]))

    return Combinator(apply, f"Select({', '.join(f'{n}={c!r}' for n, c in fs.items())})", frozenset().union(*[c.refs for c in fs.values()]))


def _let(values: dict[str, Node], make: Callable[[dict[str, Node]], Node | None]) -> Node | None:
    """What is made of some values, each of which is worked out once.  As plain columns they would be worked out wherever
    they stand, for each item of a list too."""
    trial = make(values)
    if not values or trial is None:
        return trial
    made = F.transform(F.array(F.struct(*[v.col.alias(n) for n, v in values.items()])), lambda item: make({n: Node(item[n], v.type) for n, v in values.items()}).col)
    return Node(F.get(made, 0), trial.type)


def Given(query: Any, **names: Any) -> Combinator:
    """Binds names to values of the input; all of them see the context outside."""
    q, fs = _lift(query), {n: _lift(c) for n, c in sorted(names.items())}
    inner = (q.refs - frozenset(fs)) | frozenset().union(*[c.refs for c in fs.values()])
    return Combinator(lambda x, ctx: _let({n: c.apply(x, ctx) for n, c in fs.items()}, lambda bound: q.apply(x, {**ctx, **bound})), f"Given({q!r}, {', '.join(f'{n}={c!r}' for n, c in fs.items())})", inner)


def _each(items: Node, make: Callable[[Node], Node | None]) -> Node | None:
    """A function of one value applied to each item of a list; nulls stay."""
    trial = make(Node(F.lit(None).cast(items.items), items.items))
    return None if trial is None else Node(F.transform(items.col, lambda i: make(Node(i, items.items)).col), T.ArrayType(trial.type))


def _unary(name: str, make: Callable[[Node], Node | None], *, maps: bool = False) -> Callable[[Any], Combinator]:
    """maps: whether it is applied to each item of a list."""

    def combinator(arg: Any) -> Combinator:
        c = _lift(arg)

        def apply(x: Node, ctx: dict) -> Node:
            y = c.apply(x, ctx)
            out = _each(y, make) if maps and y.items is not None else make(y)
            if out is None:
                raise OperandError(f"{name} does not take {y.type.simpleString()}")
            return out

        return Combinator(apply, f"{name}({c!r})", c.refs)

    return combinator


def Filter(test: Any) -> Combinator:
    """The input if the test is true, else null."""
    c = _lift(test)

    def apply(x: Node, ctx: dict) -> Node:
        y = c.apply(x, ctx)
        if not isinstance(y.type, (T.BooleanType, T.NullType)):
            raise OperandError(f"Filter does not take {y.type.simpleString()}")
        return Node(F.when(y.col, x.col), x.type)

    return Combinator(apply, f"Filter({c!r})", c.refs)


Len = _unary("Len", lambda y: Node(F.length(y.col).cast("bigint"), INT) if isinstance(y.type, T.StringType) else None, maps=True)
Count = _unary("Count", lambda y: Node(F.when(y.col.isNotNull(), F.size(y.col).cast("bigint")), INT) if y.items is not None else None)
Min = _unary("Min", lambda y: Node(F.array_min(y.col), y.items) if isinstance(y.items, (T.NumericType, T.StringType)) else None)
Max = _unary("Max", lambda y: Node(F.array_max(y.col), y.items) if isinstance(y.items, (T.NumericType, T.StringType)) else None)
Neg = _unary("-", lambda y: Node(-y.col, y.type) if y.number else None, maps=True)
Pos = _unary("+", lambda y: y if y.number else None, maps=True)
Invert = _unary("~", lambda y: Node(~y.col, y.type) if isinstance(y.type, T.BooleanType) else None, maps=True)


def First(query: Any, n: Any = None) -> Combinator:
    """The first item, or the first n items."""
    c, k = _lift(query), None if n is None else _lift(n)

    def apply(x: Node, ctx: dict) -> Node:
        y = c.apply(x, ctx)
        if y.items is None:
            raise OperandError(f"First does not take {y.type.simpleString()}")
        if k is None:
            return Node(F.get(y.col, 0), y.items)
        m = k.apply(x, ctx)
        if not isinstance(m.type, T.IntegralType):
            raise OperandError(f"First does not take {m.type.simpleString()}")
        size = F.when(m.col < 0, F.greatest(F.size(y.col) + m.col, F.lit(0))).otherwise(m.col)  # as far as n from the end
        return Node(F.slice(y.col, F.lit(1), size.cast("int")), y.type)

    return Combinator(apply, f"First({c!r}{'' if k is None else f', {k!r}'})", c.refs | (k.refs if k else frozenset()))


def _merged(a: Node, b: Node) -> Node:
    """Fields of both structs; the second's where both have one."""
    names = list(dict.fromkeys([*a.type.names, *b.type.names]))
    parts = [(n, (b if n in b.type.names else a)) for n in names]
    return Node(F.when(a.col.isNotNull() & b.col.isNotNull(), F.struct(*[s.col[n].alias(n) for n, s in parts])), T.StructType([T.StructField(n, s.type[n].dataType) for n, s in parts]))


def _apply(op: str, a: Node, b: Node) -> Node | None:
    if op in ("==", "!="):
        return Node(a.col == b.col if op == "==" else a.col != b.col, BOOL)
    if op in ("<", "<=", ">", ">="):
        if not (a.number and b.number) and not (isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType)):
            return None
        return Node({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op], BOOL)
    if op in "&|^":
        if not all(isinstance(n.type, (T.BooleanType, T.NullType)) for n in (a, b)):
            return None
        both = a.col.isNotNull() & b.col.isNotNull()
        return Node(F.when(both, {"&": a.col & b.col, "|": a.col | b.col, "^": a.col != b.col}[op]), BOOL)
    if op == "+" and isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
        return Node(F.concat(a.col, b.col), STR)
    if op == "+" and a.items is not None and b.items is not None:
        return Node(F.concat(a.col, b.col), a.type)
    if op == "+" and isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        return _merged(a, b)
    if not (a.number and b.number):
        return None
    whole = isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType)
    kind = INT if whole else FLOAT
    down = F.floor(a.col / b.col)  # towards minus infinity
    made = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: a.col / b.col, "//": lambda: down, "%": lambda: a.col - b.col * down}[op]()
    return Node(made.cast(FLOAT if op == "/" else kind), FLOAT if op == "/" else kind)


def _given(out: Node | None, operand: Node) -> Node | None:
    """The list, or null where the other operand is."""
    return None if out is None else Node(F.when(operand.col.isNotNull(), out.col), out.type)


def _binary(op: str, left: Any, right: Any) -> Combinator:
    f, g = _lift(left), _lift(right)

    def apply(x: Node, ctx: dict) -> Node:
        a, b = f.apply(x, ctx), g.apply(x, ctx)
        if T.NullType() in (a.type, b.type) and (a.items is not None or b.items is not None):
            return Node(F.lit(None), T.NullType())
        if a.items is not None and b.items is None:  # each item with the other operand
            out = _let({"b": b}, lambda one: _given(_each(a, lambda i: _apply(op, i, one["b"])), one["b"]))
        elif b.items is not None and a.items is None:
            out = _let({"a": a}, lambda one: _given(_each(b, lambda i: _apply(op, one["a"], i)), one["a"]))
        else:
            out = _apply(op, a, b)
        if out is None:
            raise OperandError(f"{op} does not take {a.type.simpleString()} and {b.type.simpleString()}")
        return out

    return Combinator(apply, f"({f!r} {op} {g!r})", f.refs | g.refs)


for _method, _op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "and": "&", "or": "|", "xor": "^"}.items():
    setattr(Combinator, f"__{_method}__", lambda self, other, op=_op: _binary(op, self, other))
    if _method not in ("lt", "le", "gt", "ge"):
        setattr(Combinator, f"__r{_method}__", lambda self, other, op=_op: _binary(op, other, self))
for _method, _make in {"neg": Neg, "pos": Pos, "invert": Invert}.items():
    setattr(Combinator, f"__{_method}__", lambda self, make=_make: make(self))
