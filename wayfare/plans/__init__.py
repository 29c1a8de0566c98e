"""Registered queries over the driver's tables, with SQL of the same meaning."""

from . import operators, others, queries

QUERIES = {**queries.QUERIES, **operators.QUERIES, **others.QUERIES}
SQL = {**queries.SQL, **operators.SQL, **others.SQL}
