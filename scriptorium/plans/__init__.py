"""Registered queries over the sample tables, and the same in SQL."""

from scriptorium.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
