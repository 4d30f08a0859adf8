"""Surrogate ids: dense, growing with the insertion order, never reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.operators.spread import laid_out


def assign_ids(rows: DataFrame, order: list[str | Column], above: int) -> DataFrame:
    """Add ``id``: ``above`` + 1, ``above`` + 2, ... in the given order.

    The rows are sorted over range partitions and numbered inside each; the
    number of rows before each partition is one small row per partition.
    ``above`` is the largest id ever given out, which the caller stores with
    the table, so that the id of a deleted row does not come back.
    """
    laid = laid_out(rows, order, "ids")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        laid.groupBy("_part")
        .agg(F.min("_slot").alias("_start"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    number = F.col("_slot") - F.col("_start") + F.col("_before") + F.lit(above + 1)
    return laid.join(F.broadcast(parts), "_part").select(
        number.cast("bigint").alias("id"), *rows.columns
    )
