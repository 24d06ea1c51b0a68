"""Registered queries: every operator on the given tables, with its SQL counterpart."""

from .registry import Tables, oracle_sql, queries

__all__ = ["Tables", "oracle_sql", "queries"]
