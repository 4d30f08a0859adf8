"""A table in folders of id ranges, of which a batch of changes rewrites the touched ones only.

The snapshot of a few changes is then the same folder with few new files, and
rows of other ranges, however wide, are neither read nor moved. The rows
of a patch are written beside the table first and marked; a patch that was cut
off while its ranges were replaced is finished by :func:`finish_patches`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.schemas import TABLES
from bibliospark.sources.durable import keep

#: Ids of a range.
RANGE_IDS = 1_000_000

#: The table's rows of the touched ranges and the stored changes, to the rows that replace them.
Change = Callable[[DataFrame, DataFrame], DataFrame]


def _path(root: str, name: str, part: str = "rows") -> str:
    return f"{root}/ranges/{name}/{part}"


def write_ranges(df: DataFrame, root: str, name: str, range_ids: int = RANGE_IDS) -> None:
    """Write a table with ids by id range to a new root, sorted by id."""
    number = F.floor(F.col("id") / range_ids).cast("bigint")
    laid = df.select(*TABLES[name].fieldNames(), number.alias("id_range"))
    laid = laid.repartitionByRange("id_range", "id").sortWithinPartitions("id_range", "id")
    laid.write.mode("errorifexists").partitionBy("id_range").parquet(_path(root, name))
    mark = df.sparkSession.createDataFrame([(range_ids,)], "range_ids bigint")
    mark.coalesce(1).write.mode("errorifexists").parquet(_path(root, name, "mark"))


def _with_ranges(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_schema(name)).parquet(_path(root, name))


def _schema(name: str) -> str:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name])
    return f"{fields}, id_range bigint"


def read_ranges(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _with_ranges(spark, root, name).select(*TABLES[name].fieldNames())


def patch(spark: SparkSession, root: str, name: str, changes: DataFrame, change: Change, label: str) -> list[int]:
    """Apply a batch of ``changes`` (``id`` and more) to the ranges that hold its ids, and return these ranges.

    ``change`` gives the new rows from the old ones of these ranges, with the
    same ids; it may drop rows, and the table may lose whole ranges by that.
    Changes are stored first, so that a small batch is broadcast and wide rows
    stay where they were read. ``label`` names the patch; one that is done
    already is not applied again.
    """
    if _patches(spark, root, name, "done").get(label) is not None:
        return _patches(spark, root, name, "done")[label]
    finish_patches(spark, root, name)
    size = spark.read.parquet(_path(root, name, "mark")).first()["range_ids"]
    stored = keep(changes.where(F.col("id").isNotNull()), "changes")
    number = F.floor(F.col("id").cast("bigint") / size).cast("bigint")
    asked = [r[0] for r in stored.select(number.alias("n")).distinct().collect()]
    table = _with_ranges(spark, root, name)
    touched = table.where(F.col("id_range").isin(asked)) if asked else table.where("false")
    held = sorted(r[0] for r in touched.select("id_range").distinct().collect())
    after = change(touched.drop("id_range"), stored).withColumn("id_range", number)
    after.write.mode("overwrite").parquet(_path(root, name, f"patches/{label}"))
    _note(spark, root, name, "ready", label, held)
    finish_patches(spark, root, name)
    return held


def _note(spark: SparkSession, root: str, name: str, what: str, label: str, ranges: list[int]) -> None:
    row = spark.createDataFrame([(label, ranges)], "label string, ranges array<bigint>")
    row.coalesce(1).write.mode("overwrite").parquet(_path(root, name, f"{what}/{label}"))


def _patches(spark: SparkSession, root: str, name: str, what: str) -> dict[str, list[int]]:
    try:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(_path(root, name, what)).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.label: r.ranges for r in rows}


def finish_patches(spark: SparkSession, root: str, name: str) -> list[str]:
    """Replace the ranges of patches that are written but not done; returns their labels."""
    done = _patches(spark, root, name, "done")
    left = {label: r for label, r in _patches(spark, root, name, "ready").items() if label not in done}
    for label, ranges in left.items():
        rows = spark.read.schema(_schema(name)).parquet(_path(root, name, f"patches/{label}"))
        present = {r[0] for r in rows.select("id_range").distinct().collect()}
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_range")
        writer.parquet(_path(root, name))
        for empty in set(ranges) - present:
            _clear(spark, f"{_path(root, name)}/id_range={empty}", name)
        _note(spark, root, name, "done", label, ranges)
    return list(left)


def _clear(spark: SparkSession, folder: str, name: str) -> None:
    """Leave a range that lost all its rows as a file without rows."""
    spark.createDataFrame([], TABLES[name]).coalesce(1).write.mode("overwrite").parquet(folder)
