"""Joins and rankings that stay balanced when one key holds much of the data.

A join of two stored tables needs no help: both sides are shuffled for the
join, and adaptive execution splits the partitions a heavy key makes large.
It cannot do so where a side arrives already grouped by the join key, so such
a side is stored first. For a window, keys with more rows than one task should
sort are counted exactly, and only their rows are sorted over range partitions.
Keys are counted in groups first, so that only those in large groups are
shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.sources.durable import keep

# A key with more rows than this is ranked by several tasks. Of n rows at most
# n / HEAVY_ROWS keys are heavy, which bounds what is broadcast about them.
HEAVY_ROWS = 1_000_000

# Groups of keys, by a hash, that are counted to find where heavy keys may be.
KEY_GROUPS = 1 << 16

_LOCAL_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def join(fact: DataFrame, dim: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join ``fact`` to ``dim``, which has one row per key and was grouped by it.

    ``how`` is inner, left, left_semi or left_anti.
    """
    on = [on] if isinstance(on, str) else on
    fact_types, dim_types = dict(fact.dtypes), dict(dim.dtypes)
    for name in on:
        if fact_types[name] != dim_types[name]:
            raise ValueError(f"join key {name}: {fact_types[name]} against {dim_types[name]}")
    return fact.join(keep(dim, "dimension"), on, how)


def laid_out(df: DataFrame, order: list[str | Column], label: str) -> DataFrame:
    """Sort ``df`` over range partitions and write it with its place in that order.

    ``_slot`` grows with the order; ``_part`` is the range partition of a row.
    The places are stored, as a recomputed range partitioning may draw other bounds.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return keep(placed, label).withColumn("_part", F.shiftright("_slot", _LOCAL_ROW_BITS))


def _heavy_keys(keys: DataFrame, least: int) -> DataFrame | None:
    """The values of ``_key`` in at least ``least`` rows; None if no group of keys has so many."""
    grouped = keys.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(KEY_GROUPS)))
    large = keep(grouped.groupBy("_group").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_group"), "heavy-groups")
    if large.isEmpty():
        return None
    counts = grouped.join(F.broadcast(large), "_group", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    return keep(counts.where(F.col("_n") >= least).select("_key"), "heavy-keys")


def rank_within(
    df: DataFrame,
    key: str,
    order: list[Column],
    name: str = "rank",
    min_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each key from 1; ``order`` must leave no ties.

    Keys of more than ``min_rows`` rows are sorted over range partitions
    instead of in one task. Their segments, one per key and partition, are at
    most as many as the heavy keys and the partitions together. ``counted``
    has at least as many rows of each key as ``df`` and is cheaper to count:
    a narrow table that ``df`` was joined from.
    """
    least = HEAVY_ROWS if min_rows is None else min_rows
    heavy = _heavy_keys((df if counted is None else counted).select(F.col(key).alias("_key")), least)
    in_key = Window.partitionBy(key).orderBy(*order)
    if heavy is None or heavy.isEmpty():
        return df.withColumn(name, F.row_number().over(in_key).cast("bigint"))
    same_key = F.col(key).eqNullSafe(F.col("_key"))
    light = df.join(F.broadcast(heavy), same_key, "left_anti")
    light = light.withColumn(name, F.row_number().over(in_key).cast("bigint"))
    laid = laid_out(df.join(F.broadcast(heavy), same_key, "left_semi"), [key, *order], "ranked")
    earlier = Window.partitionBy("_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        laid.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_seg"))
        .agg(F.min("_slot").alias("_start"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    same = same_key & (F.col("_part") == F.col("_seg"))
    ranked = laid.join(F.broadcast(segments), same).withColumn(
        name, F.col("_slot") - F.col("_start") + F.col("_before") + 1
    )
    return light.unionByName(ranked.select(*df.columns, name))


def high_water(table: DataFrame) -> int:
    """The largest id of a table. After deletes, use a stored mark instead."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
