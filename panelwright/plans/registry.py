"""Registers queries with their SQL."""

from __future__ import annotations


def registry():
    """(QUERIES, ORACLES, query): query(name, sql) registers the function that it decorates."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def put(f):
            queries[name] = f
            if sql is not None:
                oracles[name] = sql
            return f

        return put

    return queries, oracles, query
