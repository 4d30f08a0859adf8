"""What several operators share: tables, names, and numbering without one big task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one task sorts when rows are numbered within a key.
ROWS_PER_BUCKET = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until none of the tables has a column of that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of ``reserved`` names under other ones, and the names to give back."""
    back = {}
    for column in df.columns:
        if column.lower() in reserved:
            other = fresh(f"own_{column}", df)
            df, back[other] = df.withColumnRenamed(column, other), column
    return df, back


def given_back(df: DataFrame, columns: list[str], back: dict[str, str]) -> DataFrame:
    """Only ``columns``, those that were set aside under their own names."""
    aside = {own: other for other, own in back.items()}
    return df.select(*(F.col(aside.get(c, c)).alias(c) for c in columns))


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many buckets hold ``rows`` rows."""
    return max(1, -(-rows // per_bucket))


def number_within(
    df: DataFrame, key: str, tie: list[str], name: str, rows: int, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps, as ``name`` (long).

    Rows of a key are spread by a hash of ``tie`` over buckets of about
    ``per_bucket`` rows, each sorted by its own task, and every bucket starts
    where the one before it ends. ``df`` should be stored, as it is read twice;
    ``rows`` is its number of rows. ``key`` must not be null.
    """
    bucket = F.pmod(F.xxhash64(*tie), F.lit(buckets_for(rows, per_bucket))).cast("int")
    spread = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy(key, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*tie))
    return (
        spread.withColumn("_inside", inside - 1)
        .join(starts, [key, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_inside", "_start")
    )


def replace_column(
    df: DataFrame,
    column: str,
    name: str,
    kind: str,
    make: Callable[[list], list],
    arrow_kind: pa.DataType,
    keep_column: bool = False,
) -> DataFrame:
    """``df`` with ``column`` given to ``make``, batch by batch, and its values as ``name`` instead.

    With ``keep_column`` the column stays. The other columns pass as Arrow data, so their values stay exactly as they are.
    """
    rest = [f for f in df.schema if keep_column or f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(make(batch.column(column).to_pylist()), arrow_kind)
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, made], [*(f.name for f in rest), name])

    return df.mapInArrow(run, schema)
