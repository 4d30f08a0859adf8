"""Papers laid out for the reads by status, venue and year.

A folder for each status lets the scan of a work queue open that status
alone. Within a status, rows lie along a curve that interleaves the bits of
venue and year, so that a row group covers a small rectangle of both and
a read by either, or by both, skips the row groups outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.schemas import PAPER_COLS, TABLES

#: Bits of venue and of year on the curve; each value range is cut into so many quantiles.
CURVE_BITS = 6


def _steps(papers: DataFrame, columns: list[str], bits: int) -> dict[str, list[int]]:
    """The distinct inner quantiles of each column, at most 2 ** ``bits`` - 1."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = papers.agg(*(F.approx_percentile(c, shares, 10_000).alias(c) for c in columns)).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def _step_of(column: str, steps: list[int], kind: str) -> Column:
    """How many of ``steps`` lie at or below the value; 0 for NULL."""
    if not steps:
        return F.lit(0)
    below = F.filter(F.array(*(F.lit(s).cast(kind) for s in steps)), lambda s: s <= F.col(column))
    return F.coalesce(F.size(below), F.lit(0))


def curve(columns: dict[str, Column], bits: int) -> Column:
    """The place on the curve: the bits of all values in turn, highest first."""
    place = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for value in columns.values():
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(value.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint")))
    return place


def write_queues(papers: DataFrame, root: str, bits: int = CURVE_BITS, options: dict[str, str] | None = None) -> None:
    """Write the papers by status and curve to a new root; no row is left out, also without a status."""
    by = ["venue_id", "year"]
    kinds = {c: papers.schema[c].dataType.simpleString() for c in by}
    steps = _steps(papers, by, bits)
    values = {c: _step_of(c, steps[c], kinds[c]) for c in by}
    placed = papers.select(*PAPER_COLS, curve(values, bits).alias("place"))
    order = ["status", "place", "id"]
    laid = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    laid.write.mode("errorifexists").options(**(options or {})).partitionBy("status").parquet(f"{root}/papers_by_status")


def read_queues(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TABLES["papers"]).parquet(f"{root}/papers_by_status").select(*PAPER_COLS)
