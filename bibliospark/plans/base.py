"""The registry of queries and the SQL that states what each should give."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from bibliospark.sources.driver_tables import SQL

NOW = datetime(2025, 1, 1)
NOW_SQL = "TIMESTAMP '2025-01-01'"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def with_shapes(body: str, more: dict[str, str] | None = None) -> str:
    """Put the table shapes that ``body`` names in front of it."""
    parts = {**SQL, **(more or {})}
    text = body + "".join((more or {}).values())
    used = [n for n in parts if n in (more or {}) or re.search(rf"\b{n}\b", text)]
    head = ", ".join(f"{n} AS ({parts[n]})" for n in used)
    recursive = any("UNION ALL" in parts[n] and re.search(rf"\b{n}\b", parts[n]) for n in used)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if used else body


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    """Register a query; without SQL the driver checks its rows only."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_shapes(sql, more)
        return run

    return add
