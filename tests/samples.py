"""Small hand-made corpus tables."""

from __future__ import annotations

from datetime import datetime

from bibliospark.schemas import TABLES

NOW = datetime(2025, 1, 1, 12, 0, 0)


def make(spark, table: str, *rows: dict):
    """Rows of a corpus table; fields that a row leaves out are NULL."""
    names = TABLES[table].fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])


def papers(spark, *ids: int, **fields):
    return make(spark, "papers", *({"id": i, "title": f"paper {i}", **fields} for i in ids))


def at(minute: int) -> datetime:
    return datetime(2024, 1, 1, 0, minute)
