"""Names of queries, their callables and their SQL."""

from __future__ import annotations

from . import documents, library, notations, rules, streams, structured, tables

MODULES = (documents, library, structured, tables, rules, notations, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
