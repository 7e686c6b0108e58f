"""Registered queries over the driver tables, each with its SQL oracle."""

from queries.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
