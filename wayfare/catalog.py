"""Classes of entities and the arrows between them, bound to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .syntax import QueryError

KINDS = {T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float", T.StringType: "str", T.DateType: "date", T.TimestampType: "time", T.TimestampNTZType: "time"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return "money" if t.scale == 2 else "float"
    if isinstance(t, T.ArrayType):
        return f"many {kind_of(t.elementType)}"
    return KINDS.get(type(t), "any")


@dataclass
class Arrow:
    """An attribute (a column of the class) or a link.

    A link names its target class and pairs of (own column, target column).  It is singular where the target's columns
    are the target's key, and plural otherwise; ``optional`` says that a value may be missing."""

    name: str
    column: str | None = None
    kind: str | None = None
    target: str | None = None
    on: tuple[tuple[str, str], ...] = ()
    plural: bool = False
    optional: bool = False


@dataclass
class Class:
    """A class: how its rows are read, its key (what identifies an entity), what is shown of it, and its arrows."""

    name: str
    load: Callable[[], DataFrame]
    key: tuple[str, ...]
    select: tuple[str, ...] = ()
    arrows: dict[str, Arrow] = field(default_factory=dict)
    _df: DataFrame | None = None

    def kind(self, arrow: Arrow) -> str:
        """The type of an attribute's values."""
        if arrow.kind is None:
            if arrow.column not in self.df.columns:
                raise QueryError(f"{self.name} has no column {arrow.column}")
            arrow.kind = kind_of(self.df.schema[arrow.column].dataType)
        return arrow.kind

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.load()
        return self._df


class Catalog:
    """Classes by name.  ``attach`` adds one; ``link`` adds a link and, if named, its inverse."""

    def __init__(self, spark: SparkSession):
        self.spark, self.classes = spark, {}
        self.flat = False  # whether queries give flat tables

    def attach(self, name: str, rows: DataFrame | Callable[[], DataFrame], key: str | tuple[str, ...], *, attributes: dict[str, str] | None = None, select: tuple[str, ...] = (), optional: tuple[str, ...] = (), kinds: dict[str, str] | None = None) -> Class:
        """attributes: columns by the names they get in queries, else all columns under their own names.

        Rows given as a function are read when a query first needs the class."""
        load = rows if callable(rows) else lambda: rows
        c = self.classes[name] = Class(name, load, (key,) if isinstance(key, str) else tuple(key), tuple(select))
        for attr, column in (attributes or {x: x for x in c.df.columns}).items():
            c.arrows[attr] = Arrow(attr, column, (kinds or {}).get(attr), optional=attr in optional)
        return c

    def link(self, source: str, name: str, target: str, on: dict[str, str], *, inverse: str | None = None, optional: bool = False) -> None:
        """A singular link along columns ``on`` (own column: target's key column) and its plural inverse."""
        pairs = tuple(on.items())
        self.classes[source].arrows[name] = Arrow(name, target=target, on=pairs, optional=optional)
        if inverse:
            self.classes[target].arrows[inverse] = Arrow(inverse, target=source, on=tuple((b, a) for a, b in pairs), plural=True)

    def __getitem__(self, name: str) -> Class:
        if name not in self.classes:
            raise QueryError(f"there is no class {name}")
        return self.classes[name]
