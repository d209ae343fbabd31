"""Registry of runnable queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """A named view of the model tables for oracle SQL."""
    CTES[name] = body.strip()


def with_ctes(body: str) -> str:
    """Prefix SQL with the views it uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, sub in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(sub)

    visit(body)
    chosen = [f"{n} AS (\n{CTES[n]}\n)" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(chosen) + "\n" if chosen else "") + body.strip()


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` must return the same columns."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return add
