"""Registered queries with their SQL counterparts.

A counterpart is written for DuckDB on the same Parquet tables. Shared pieces are
named table expressions (``s_...``); a query pulls in the ones its text mentions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}
AS_OF: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    """Define a named table expression for the SQL counterparts."""
    SHARED[name] = sql.strip()


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in sorted(set(re.findall(r"\bs_\w+\b", sql))):
        if name in SHARED and name not in found:
            _needed(SHARED[name], found)
            found.append(name)
    return found


def complete(sql: str, as_of: str | None = None) -> str:
    """Prefix a statement with the shared expressions it uses, each after its own inputs.

    With ``as_of`` the shipped lines (``s_lines``) end before that day, as for a holdout.
    """
    used = _needed(sql, [])
    if not used:
        return sql.strip()
    cut = {"s_lines": f"{SHARED['s_lines']}\nWHERE l.l_shipdate < TIMESTAMP '{as_of}'"} if as_of else {}
    body = ",\n".join(f"{n} AS (\n{cut.get(n, SHARED[n])}\n)" for n in used)
    return f"WITH {body}\n{sql.strip()}"


def query(name: str, sql: str | None = None, as_of: str | None = None) -> Callable[[Query], Query]:
    """Register a query function, with its SQL counterpart when there is one; ``as_of`` is the
    first day that a holdout query does not know."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if as_of is not None:
            AS_OF[name] = as_of
        return fn

    return add
