"""Databases: every table, column and foreign key of a schema becomes a class, an attribute and two links.

The catalog is asked through the driver's own description of it, so any database with a JDBC driver will do."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog

@dataclass
class Table:
    """columns: name -> may be null; links: column -> (target table, target column)."""

    columns: dict[str, bool]
    key: tuple[str, ...] = ()
    links: dict[str, tuple[str, str]] = field(default_factory=dict)


def link_name(column: str) -> str:
    """The name of a link: its column without ``_id``."""
    return column[:-3] if column.endswith("_id") and len(column) > 3 else column


def inverse_name(taken: set[str], table: str, link: str) -> str:
    """The name of an inverse link: its table, or ``table_via_link`` where that is taken."""
    return table if table not in taken else f"{table}_via_{link}"


def attach_tables(db: Catalog, tables: dict[str, Table], read) -> Catalog:
    """Attaches described tables; read(table) gives a DataFrame, which a query loads as far as it needs."""
    known = {n: t for n, t in tables.items() if t.key}
    for n, t in known.items():
        db.attach(n, (lambda n=n: read(n)), t.key, attributes={c: c for c in t.columns if c not in t.links}, optional=tuple(c for c, null in t.columns.items() if null))
    sources: dict[str, list[tuple[str, str]]] = {}
    for n, t in sorted(known.items()):
        for c, (target, column) in sorted(t.links.items()):
            if target in known and known[target].key == (column,):
                sources.setdefault(target, []).append((n, c))
                db.link(n, link_name(c), target, {c: column}, optional=t.columns[c])
    for target, all_of in sources.items():
        several = {n for n, _ in all_of if sum(m == n for m, _ in all_of) > 1}
        for n, c in all_of:
            taken = set(db[target].arrows) | several
            db.link(n, link_name(c), target, {c: known[target].key[0]}, inverse=inverse_name(taken, n, link_name(c)), optional=known[n].columns[c])
    return db


def described(columns: list[tuple], keys: list[tuple]) -> dict[str, Table]:
    """Tables from rows of columns (table, column, place, YES or NO for nulls) and of keys (name, PRIMARY KEY, UNIQUE or
    FOREIGN KEY, table, column, place, place in the key that it points to, that key's name); only foreign keys of one
    column become links."""
    tables: dict[str, Table] = {}
    for table, column, _, nullable in sorted(columns, key=lambda r: (r[0], r[2])):
        tables.setdefault(table, Table({})).columns[column] = nullable == "YES"
    groups: dict[str, list[tuple]] = {}
    for r in keys:
        groups.setdefault(r[0], []).append(r)
    unique = {}
    for name, rows in groups.items():
        rows.sort(key=lambda r: r[4])
        if rows[0][1] != "FOREIGN KEY":
            unique[name] = (rows[0][2], tuple(r[3] for r in rows))
            if rows[0][1] == "PRIMARY KEY":
                tables[rows[0][2]].key = unique[name][1]
    for table, cols in unique.values():
        if not tables[table].key:
            tables[table].key = cols
    for rows in groups.values():
        if rows[0][1] == "FOREIGN KEY" and len(rows) == 1 and rows[0][6] in unique:
            target, cols = unique[rows[0][6]]
            tables[rows[0][2]].links[rows[0][3]] = (target, cols[0])
    return tables


def _rows(found: object, *names: str) -> list[tuple]:
    """The named columns of a JDBC result."""
    out = []
    while found.next():
        out.append(tuple(found.getString(n) for n in names))
    found.close()
    return out


def introspect(spark: SparkSession, url: str, schema: str, driver: str | None = None, **properties: str) -> dict[str, Table]:
    """The tables of a schema with their keys, as the database's driver describes them."""
    jvm = spark._jvm
    if driver:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        meta = connection.getMetaData()
        names = {n for n, kind in _rows(meta.getTables(None, schema, "%", None), "TABLE_NAME", "TABLE_TYPE") if kind in ("TABLE", "BASE TABLE", "PARTITIONED TABLE")}
        columns = [(t, c, int(at), null) for t, c, at, null in _rows(meta.getColumns(None, schema, "%", "%"), "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION", "IS_NULLABLE") if t in names]
        keys: list[tuple] = []
        for t in sorted(names):
            keys += [(f"{t} primary", "PRIMARY KEY", t, c, int(at), None, None) for c, at in _rows(meta.getPrimaryKeys(None, schema, t), "COLUMN_NAME", "KEY_SEQ")]
            keys += [(f"{t} {i}", "UNIQUE", t, c, int(at), None, None) for i, c, at in _rows(meta.getIndexInfo(None, schema, t, True, True), "INDEX_NAME", "COLUMN_NAME", "ORDINAL_POSITION") if i and c]
            for target, at, own, name, column in _rows(meta.getImportedKeys(None, schema, t), "PKTABLE_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "FK_NAME", "PKCOLUMN_NAME"):
                keys.append((f"{t} to {name}", "FOREIGN KEY", t, own, int(at), int(at), f"{target} by {t} {name}"))
                keys.append((f"{target} by {t} {name}", "UNIQUE", target, column, int(at), None, None))
    finally:
        connection.close()
    return described(columns, keys)


def attach_database(db: Catalog, url: str, *, schema: str = "public", partitions: dict[str, dict] | None = None, **options: str) -> Catalog:
    """Reads a database's catalog and attaches its tables.

    Queries push filters and columns down to the database.  ``partitions`` gives a table's options for reading in
    parallel (partitionColumn, lowerBound, upperBound, numPartitions); ``options`` are those of the connection (driver,
    user, password, ...)."""
    tables = introspect(db.spark, url, schema, **options)

    def read(table: str) -> DataFrame:
        return db.spark.read.format("jdbc").options(url=url, **options, **(partitions or {}).get(table, {})).option("dbtable", f'"{schema}"."{table}"').load()

    return attach_tables(db, tables, read)
