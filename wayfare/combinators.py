"""Queries built in Python: combinators that make the same trees as query texts.

``Q`` wraps a tree; ``a >> b`` composes, ``Then...`` objects extend what stands before them, and operators build
scalar expressions: ``Field("employee") >> ThenFilter(Field("salary") > 1000) >> ThenSelect(Field("name"))``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import Catalog
from .compiler import rule
from .flow import Flow, Val, flatten, settled
from .functions import aggregates
from .operators.ordering import exploded
from .syntax import Call, Compose, Lit, Named, Regex


def tree(x: Any) -> Any:
    """The tree of a combinator, a name (``"=> name"`` pairs are tuples), or a constant."""
    if isinstance(x, Q):
        return x.tree
    if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str):
        return Named(x[0], tree(x[1]))
    if isinstance(x, (Call, Compose, Lit, Named, Regex)):
        return x
    if isinstance(x, list):
        return Call("array", tuple(tree(y) for y in x))
    return Lit(x)


class Q:
    def __init__(self, node: Any):
        self.tree = node

    def __rshift__(self, other: Q | Then | str) -> Q:
        if isinstance(other, Then):
            return Q(other.make(self.tree))
        return Q(Compose(self.tree, Call(other) if isinstance(other, str) else other.tree))

    def run(self, catalog: Catalog, **params: Any):
        from .query import execute

        return execute(catalog, self, **params)

    def _op(self, name: str, *args: Any) -> Q:
        return Q(Call(name, (self.tree, *map(tree, args))))

    def __eq__(self, other: Any) -> Q:  # type: ignore[override]
        return self._op("==", other)

    def __ne__(self, other: Any) -> Q:  # type: ignore[override]
        return self._op("!=", other)

    __hash__ = None  # type: ignore[assignment]


for _method, _name in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "÷", "and": "&", "or": "|"}.items():
    setattr(Q, f"__{_method}__", lambda self, other, n=_name: self._op(n, other))
for _method, _name in {"radd": "+", "rsub": "-", "rmul": "*", "rtruediv": "/"}.items():
    setattr(Q, f"__{_method}__", lambda self, other, n=_name: Q(Call(n, (tree(other), self.tree))))
for _method, _name in {"neg": "-", "invert": "!"}.items():
    setattr(Q, f"__{_method}__", lambda self, n=_name: self._op(n))


class Then:
    """Extends the query before it."""

    def __init__(self, make: Callable[[Any], Any]):
        self.make = make

    def __rshift__(self, other: Q | Then) -> Then:
        return Then(lambda q: (Q(self.make(q)) >> other).tree)


def _then(name: str) -> Callable[..., Then]:
    def combinator(*args: Any) -> Then:
        return Then(lambda q: Call(name, (q, *map(tree, args))))

    combinator.__doc__ = f"``q:{name}(...)``"
    return combinator


def _of(name: str) -> Callable[..., Q]:
    def combinator(*args: Any) -> Q:
        return Q(Call(name, tuple(map(tree, args))))

    combinator.__doc__ = f"``{name}(...)``"
    return combinator


def Field(name: str) -> Q:
    return Q(Call(name))


def Fields(*names: str) -> tuple[Q, ...]:
    return tuple(Field(n) for n in names)


def FieldIfExists(name: str) -> Q:
    """The field of that name, or what is in focus if it has none."""
    return Q(Call("field_if_exists", (Call(name),)))


def Const(value: Any) -> Q:
    return Q(tree(value) if isinstance(value, list) else Lit(value))


def Parameter(name: str) -> Q:
    return Q(Call(name))


def Given(q: Any, **names: Any) -> Q:
    return Q(Call("given", (tree(q), *[Named(n, tree(x)) for n, x in names.items()])))


def Using(**names: Any) -> Callable[[Any], Q]:
    return lambda q: Given(q, **names)


def Define(**names: Any) -> Then:
    return Then(lambda q: Call("define", (q, *[Named(n, tree(x)) for n, x in names.items()])))


def Decorate(name: str, q: Any) -> Q:
    """Names a query."""
    return Q(Named(name, tree(q)))


def ThenTag(name: str) -> Then:
    return Then(lambda q: Named(name, q))


ThenDecorate = ThenTag


def ThenSummarize(*fields: Any) -> Then:
    """One record of aggregates over the whole flow, which goes by its own name in them."""
    return Then(lambda q: Call("select", (Call("group", (q,)), *map(tree, fields))))


@dataclass(frozen=True)
class Function:
    """A function of columns, held by the trees that apply it; many: gives an array, whose elements are the values."""

    of: Callable[..., Column]
    kind: str
    optional: bool = False
    many: bool = False


@rule("given_function")
def _applied(c: Any, s: Any, args: tuple) -> Any:
    f = args[0].value
    if not f.many:
        return c.lift(lambda *vals: Val(f.kind, f.of(*[v.col for v in vals]), f.optional or any(v.optional for v in vals)), args[1:], s)
    values = [c.compile(t, s) for t in args[1:]]
    flows = [v for v in values if isinstance(v, Flow)]
    made = lambda vals: F.coalesce(f.of(*[v.col for v in vals]), F.array())
    if not flows:
        return exploded(s, made(values), f.kind, None)
    if len(flows) > 1:
        flow, vals = c.product(flows, s)
    else:
        flow = settled(flows[0])
        vals = [flow.val]
    if any(isinstance(v, Val) and not v.const for v in values):
        flow.frame.reach(s.frame)
    it = iter(vals)
    return flatten(flow, exploded(s.at(flow.frame, flow.val), made([next(it) if isinstance(v, Flow) else v for v in values]), f.kind, None))


def Lift(function: Callable[..., Column], kind: str, *args: Any, optional: bool = False) -> Q:
    """Applies any function of columns, a pandas UDF too, to values: for many values to each combination."""
    return Q(Call("given_function", (Lit(Function(function, kind, optional)), *map(tree, args))))


def LiftMany(function: Callable[..., Column], kind: str, *args: Any) -> Q:
    """As Lift, for a function that gives an array: its elements are the values; a missing array has none."""
    return Q(Call("given_function", (Lit(Function(function, kind, many=True)), *map(tree, args))))


def Aggregate(function: Callable[[Column], Column], kind: str, q: Any, zero: Any = None) -> Q:
    """Any function from a column to an aggregate of it, a grouped pandas UDF too; zero: its value for no values."""
    return Q(Call("given_aggregate", (Lit(aggregates.Aggregate(function, zero, kind)), tree(q))))


def ThenAggregate(function: Callable[[Column], Column], kind: str, zero: Any = None) -> Then:
    return Then(lambda q: Aggregate(function, kind, Q(q), zero).tree)


@rule("field_if_exists")
def _field_if_exists(c: Any, s: Any, args: tuple) -> Any:
    found = c.name(args[0].name, s)
    return s.focus if found is None else found


It, Null, Empty = Q(Call("here")), Q(Lit(None)), Q(Call("array"))
Count, Exists, AnyOf, AllOf, MaxOf, MinOf, SumOf, MeanOf = [_of(n) for n in ("count", "exists", "any", "all", "max", "min", "sum", "mean")]
Sort, Connect, AndConnect, Unique, Frame, Merge, Switch, Record, Mix, Pack = [_of(n) for n in ("sort", "connect", "and_connect", "unique", "frame", "merge", "switch", "record", "mix", "pack")]
Asc, Desc, NullFirst, NullLast = [_of(n) for n in ("asc", "desc", "nullfirst", "nulllast")]
Before, After, Around, AndBefore, AndAfter, AndAround = [_of(n) for n in ("before", "after", "around", "and_before", "and_after", "and_around")]
ExpectOne, ExpectAtMostOne, ExpectAtLeastOne, ExpectAnything = [_of(n) for n in ("expect_one", "expect_at_most_one", "expect_at_least_one", "expect_anything")]
ThenCount, ThenExists, ThenAny, ThenAll, ThenMax, ThenMin, ThenSum, ThenMean = [_then(n) for n in ("count", "exists", "any", "all", "max", "min", "sum", "mean")]
ThenFilter, ThenSort, ThenTake, ThenSkip, ThenSelect, ThenGroup, ThenRollUp, ThenUnique, ThenFrame, ThenElse, ThenFirst, ThenReverse, ThenCube = [
    _then(n) for n in ("filter", "sort", "take", "skip", "select", "group", "rollup", "unique", "frame", "then_else", "first", "reverse", "group_cube")
]
ThenExpectOne, ThenExpectAtMostOne, ThenExpectAtLeastOne = [_then(n) for n in ("expect_one", "expect_at_most_one", "expect_at_least_one")]
