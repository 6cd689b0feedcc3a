"""Registered queries, each with its SQL on the same tables where SQL can say it."""

from segmentlab.checks.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
