"""Bridge, edges and their ends as bucketed tables, so that a join leaves the stored sides in place.

A link table is stored once for each of its ends, bucketed and sorted by that
end; the table at the end is bucketed alike by its id. Rows of one key share a
bucket, so keys with very many rows are kept apart, in a plain folder
whose join adaptive execution may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.sources.durable import keep

#: Buckets of a table. Tables that are to be joined in place have as many.
BUCKETS = 64
#: A key with more rows than this is kept apart.
HEAVY_ROWS = 1_000_000


class Bucketed(NamedTuple):
    """The bucketed rows, and those of heavy keys if there are any."""

    light: DataFrame
    heavy: DataFrame | None

    def through(self, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``run`` on both parts, put together."""
        found = run(self.light)
        return found if self.heavy is None else found.unionByName(run(self.heavy))


def through(table: DataFrame | Bucketed, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return table.through(run) if isinstance(table, Bucketed) else run(table)


def _place(root: str, name: str, key: str) -> tuple[str, str]:
    """The folder of a bucketed table and its name in the catalog."""
    path = f"{root}/buckets/{name}_by_{key}"
    return path, f"{name}_by_{key}_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_buckets(
    df: DataFrame, root: str, name: str, key: str, buckets: int = BUCKETS, heavy_rows: int = HEAVY_ROWS
) -> None:
    """Write ``df`` bucketed and sorted by ``key`` to a new place below ``root``.

    A row without a key joins nothing and is kept with the heavy ones.
    """
    path, table = _place(root, name, key)
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    heavy = keep(counts.where((F.col("n") > heavy_rows) | F.col(key).isNull()).select(key), "heavy-keys")
    some = not heavy.isEmpty()
    light = df
    if some:
        light = df.where(F.col(key).isNotNull()).join(heavy, key, "left_anti").select(*df.columns)
        same = F.col(key).eqNullSafe(F.col("heavy_key"))
        apart = df.join(heavy.withColumnRenamed(key, "heavy_key"), same, "left_semi")
        apart.write.mode("errorifexists").parquet(f"{path}/heavy")
    dealt = light.repartition(buckets, key)
    writer = dealt.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/light")
    writer.format("parquet").saveAsTable(table)
    mark = df.sparkSession.createDataFrame([(buckets, some)], "buckets int, heavy boolean")
    mark.coalesce(1).write.mode("errorifexists").parquet(f"{path}/mark")


def open_buckets(spark: SparkSession, root: str, name: str, key: str) -> Bucketed:
    """The table bucketed by ``key``; its buckets are declared in this session if they are not known to it."""
    path, table = _place(root, name, key)
    mark = spark.read.parquet(f"{path}/mark").first()
    if not spark.catalog.tableExists(table):
        fields = spark.read.parquet(f"{path}/light").schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {mark.buckets} BUCKETS LOCATION '{path}/light'"
        )
    heavy = spark.read.parquet(f"{path}/heavy") if mark.heavy else None
    return Bucketed(spark.table(table), heavy)


def forget_buckets(spark: SparkSession, root: str, name: str, key: str) -> None:
    """Take the table out of the session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{_place(root, name, key)[1]}`")
