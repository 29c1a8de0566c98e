"""Queries from text: parse, compile, run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from .catalog import Catalog
from .compiler import Bound, Compiler, Scope, load_rules
from .functions.scalars import literal
from .operators import output
from .syntax import Call, Lit, QueryError, parse

load_rules()
from .functions import aggregates  # noqa: E402,F401


class Query:
    """A query over a catalog, parsed once and run with any values of its parameters.

    A parameter is a plain value, None, or a list of values.  ``dialect`` "v2" counts a row among its neighbours."""

    def __init__(self, catalog: Catalog, query: Any, *, dialect: str = "v1", names: tuple[str, ...] = ()):
        self.catalog, self.dialect, self.names = catalog, dialect, tuple(names)
        self.tree = parse(query) if isinstance(query, str) else getattr(query, "tree", query)

    def params(self) -> tuple[str, ...]:
        return self.names

    def __call__(self, **params: Any) -> DataFrame:
        missing = [n for n in self.names if n not in params]
        if missing:
            raise QueryError(f"no value for {', '.join(missing)}")
        c = Compiler(self.catalog, dialect=self.dialect)
        env = {}
        for name, v in params.items():
            value = Call("array", tuple(Lit(x) for x in v)) if isinstance(v, (list, tuple)) else literal(v).named(name)
            env[name] = Bound(c.root, value)
        tree = Call("dataframe", (self.tree,)) if self.catalog.flat else self.tree
        return output.table(c, c.compile(tree, Scope(c.root, c.top.focus, env, c.root)))

    def explain(self, **params: Any) -> str:
        """The physical plan as text."""
        return self(**params)._jdf.queryExecution().explainString(self.catalog.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def formatdf(catalog: Catalog, on: bool = True) -> None:
    """Whether the catalog's queries give flat tables, as ``:dataframe`` does, without being asked to."""
    catalog.flat = on


def prepare(catalog: Catalog, query: Any, *names: str, dialect: str = "v1") -> Query:
    return Query(catalog, query, dialect=dialect, names=names)


def execute(catalog: Catalog, query: Any, *, dialect: str = "v1", **params: Any) -> DataFrame:
    return Query(catalog, query, dialect=dialect)(**params)
