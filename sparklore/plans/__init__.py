"""Registered queries with DuckDB SQL for the same rows."""

from . import files, registry

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "files"]
