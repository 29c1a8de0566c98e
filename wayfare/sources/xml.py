"""XML documents as a class of nodes: parents, children, descendants, names, attributes and texts."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog

SCHEMA = "doc string, node bigint, parent bigint, last bigint, depth int, name string, attributes map<string,string>, text string, inside array<bigint>"


def elements(content: bytes) -> list[list]:
    """[node, parent, last, depth, name, attributes, text, inside] of each element, in document order.

    Read in one pass, without recursion: a text is a part of the document's whole text."""
    rows: list[list] = []
    stack: list[int] = []
    parts: list[str] = []
    length = 0
    named = lambda n: "{" + n if "}" in n else n

    def start(name: str, attributes: dict) -> None:
        above = rows[stack[-1]][0] if stack else None
        rows.append([len(rows) + 1, above, None, len(stack), named(name), [(named(k), v) for k, v in attributes.items()], length, [rows[i][0] for i in stack]])
        stack.append(len(rows) - 1)

    def end(_: str) -> None:
        row = rows[stack.pop()]
        row[2], row[6] = len(rows), (row[6], length)

    def text(piece: str) -> None:
        nonlocal length
        parts.append(piece)
        length += len(piece)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(content, True)
    whole = "".join(parts)
    for row in rows:
        row[6] = whole[slice(*row[6])]
    return rows


def parse_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each element, in document order.  ``node`` counts them from 1; ``last`` is the last one inside;
    ``text`` is all text inside, tails of inner elements included; ``inside`` are the nodes that it lies in.  Names in a
    namespace are "{uri}name"."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(pa.int64())]
    for b in batches:
        for doc, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            cols = list(zip(*[[doc, *r] for r in elements(content)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc", "node", "parent", "last", "depth", "name", "attributes", "text", "inside"])


def open_xml(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all documents under a path; each document is parsed by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse_nodes, SCHEMA)


def matching(nodes: DataFrame, name: str | None = None, **attributes: str | bool) -> DataFrame:
    """Nodes of that name; an attribute is to be there (True), not to be there (False), or to have that value."""
    if name is not None:
        nodes = nodes.filter(F.col("name") == name)
    for a, v in attributes.items():
        value = F.element_at("attributes", a)
        nodes = nodes.filter(value.isNotNull() if v is True else value.isNull() if v is False else value == v)
    return nodes


def root(nodes: DataFrame, name: str | None = None, **attributes: str | bool) -> DataFrame:
    return matching(nodes.filter("parent IS NULL"), name, **attributes)


def parent(nodes: DataFrame, of: DataFrame) -> DataFrame:
    ups = of.select(F.col("doc").alias("_d"), F.col("parent").alias("_p"))
    return nodes.join(ups, (F.col("doc") == F.col("_d")) & (F.col("node") == F.col("_p"))).drop("_d", "_p")


def child(nodes: DataFrame, of: DataFrame, name: str | None = None, **attributes: str | bool) -> DataFrame:
    ups = of.select(F.col("doc").alias("_d"), F.col("node").alias("_p"))
    return matching(nodes, name, **attributes).join(ups, (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_p"))).drop("_d", "_p")


def descendant(nodes: DataFrame, of: DataFrame, name: str | None = None, **attributes: str | bool) -> DataFrame:
    """Nodes inside, once for each node of ``of`` that they lie in: found by the list of what each lies in."""
    ups = of.select(F.col("doc").alias("_d"), F.col("node").alias("_p"))
    inside = matching(nodes, name, **attributes).withColumn("_i", F.explode("inside"))
    return inside.join(ups, (F.col("doc") == F.col("_d")) & (F.col("_i") == F.col("_p"))).drop("_d", "_p", "_i")


def attach_xml(db: Catalog, name: str, path: str, *, attributes: tuple[str, ...] = ()) -> None:
    """A class of all elements, with links parent and child; attributes of elements under their own names."""
    nodes = lambda: open_xml(db.spark, path).select("*", *[F.element_at("attributes", a).alias(f"attr_{a}") for a in attributes])
    db.attach(name, nodes, ("doc", "node"), attributes={"name": "name", "text": "text", "depth": "depth", **{a: f"attr_{a}" for a in attributes}}, optional=tuple(attributes))
    db.link(name, "parent", name, {"doc": "doc", "parent": "node"}, inverse="child", optional=True)
