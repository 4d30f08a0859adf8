"""Jobs that read a stored snapshot and write the next one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from bibliospark.operators.graph import edge_deltas, merge_citation_counts, refresh_citation_counts
from bibliospark.operators.ingest import seed_venues
from bibliospark.sources.ranges import patch
from bibliospark.sources.tables import declare_tables, high_water, read_table, write_snapshot


def initialise(spark: SparkSession, root: str, next_root: str, now: datetime | None = None) -> int:
    """Declare all tables, then write the venues with the default ones added below ``next_root``.

    Returns the number of venues added; run again on its result, it adds none.
    """
    declare_tables(spark, root)
    before, mark = read_table(spark, root, "venues"), high_water(spark, root, "venues")
    write_snapshot(seed_venues(before, mark, now), next_root, "venues", mark)
    return read_table(spark, next_root, "venues").count() - before.count()


def refresh_counts(spark: SparkSession, root: str, next_root: str, now: datetime | None = None) -> int:
    """Write the papers below ``root`` with fresh citation counts below ``next_root``.

    Returns the number of papers updated, which is all of them.
    """
    papers, citations = (read_table(spark, root, n) for n in ("papers", "citations"))
    mark = high_water(spark, root, "papers")
    write_snapshot(refresh_citation_counts(papers, citations, now), next_root, "papers", mark)
    return read_table(spark, next_root, "papers").count()


def merge_counts(
    spark: SparkSession,
    root: str,
    label: str,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    now: datetime | None = None,
) -> list[int]:
    """Bring the counts of the papers stored by id range up to date with a batch of edges.

    Reads the batch and the ranges of the papers it cites, and rewrites these
    ranges alone; returns them. ``label`` names the batch, which is merged once.
    """
    deltas = edge_deltas(added, removed)
    return patch(spark, root, "papers", deltas, lambda rows, few: merge_citation_counts(rows, few, now), label)
