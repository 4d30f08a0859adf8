"""Corpus tables as folders of Parquet files, one folder per snapshot.

A snapshot is laid out for the reads it serves: rows are range-sorted by the
columns of ``LAYOUT``, so that a keyed read skips the row groups whose bounds
exclude its keys, and row groups have bloom filters of the unique columns in ``POINT_KEYS``, which
lie in no order. Beside a table with ids lies the largest id ever given out,
which a later insert starts above even if that row is gone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.schemas import LAYOUT, POINT_KEYS, TABLES


def declare_tables(spark: SparkSession, root: str) -> None:
    """Write an empty snapshot of every table that has none; safe to repeat."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def _mark_path(root: str, name: str) -> str:
    return f"{root}/marks/{name}"


def high_water(spark: SparkSession, root: str, name: str) -> int:
    """The largest id that the table has ever given out, by its snapshot below ``root``."""
    try:
        mark = spark.read.parquet(_mark_path(root, name)).agg(F.max("above")).first()[0]
    except AnalysisException:  # a snapshot without a mark, such as a declared one
        mark = read_table(spark, root, name).agg(F.max("id")).first()[0]
    return mark or 0


def _bloom_filters(name: str) -> dict[str, str]:
    """Options that make the Parquet writer keep bloom filters, as small as a row group allows."""
    enabled = {f"parquet.bloom.filter.enabled#{c}": "true" for c in POINT_KEYS[name]}
    return {**enabled, "parquet.bloom.filter.adaptive.enabled": "true"} if enabled else {}


def write_snapshot(
    df: DataFrame, root: str, name: str, above: int = 0, options: dict[str, str] | None = None
) -> None:
    """Write the next snapshot of a table to a new root.

    A snapshot is never written over the one it was made from, and the write
    fails if the table is already there. ``above`` is the mark of the snapshot
    before; the new mark is the larger of it and the ids written. ``options``
    are for the Parquet writer.
    """
    columns = TABLES[name].fieldNames()
    by = LAYOUT[name]
    laid = df.select(*columns).repartitionByRange(*by).sortWithinPartitions(*by)
    writer = laid.write.mode("errorifexists").options(**_bloom_filters(name), **(options or {}))
    writer.parquet(f"{root}/{name}")
    if "id" in columns:
        spark = df.sparkSession
        written = read_table(spark, root, name).agg(F.greatest(F.max("id"), F.lit(above)).alias("above"))
        written.coalesce(1).write.mode("errorifexists").parquet(_mark_path(root, name))
