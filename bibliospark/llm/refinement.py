"""Exact duplicates by progressive refinement: length, then a hash of the start, then a hash of the whole text.

Each step looks only at the groups that the one before it left with more than
one row. Lengths and starts are narrow and stored once; whole texts are read
only where both are shared, so a text that no other can equal is never hashed
as a whole, unless the caller wants every digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.sources.durable import keep

#: Characters of a text that make its start.
START = 64


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys of more than one row; rows are counted before the shuffle, so a hot key is one row a task."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] | None = None,
    every_digest: bool = False,
    start: int = START,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows are copies if their texts are equal after ``normalize`` (nothing by
    default). Of a group the row with the largest id stays; ``keep_id`` is its
    id. A null text counts as empty. A null id stays only where no row of the
    group has an id, and of rows with the same id one stays. ``text_sha256``
    (lower-case hex) is null for rows whose length or start no other row
    shares, unless ``every_digest`` is set. Whole texts are compared by length
    and SHA-256. Other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalize(text) if normalize else text
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        F.octet_length("text").alias("length"),
        F.xxhash64(F.substring("text", 1, start)).alias("start"),
    )
    narrow = keep(read.select("length", "start"), "text-starts")
    by_length = keep(_shared(narrow, ["length"]), "shared-lengths")
    open_rows = narrow.join(by_length, "length", "left_semi")
    by_start = keep(_shared(open_rows, ["length", "start"]).withColumn("shared", F.lit(True)), "shared-starts")
    digest = F.sha2("text", 256)
    marked = read.join(by_start, ["length", "start"], "left").select(
        "doc_id",
        "length",
        F.coalesce("shared", F.lit(False)).alias("shared"),
        (digest if every_digest else F.when(F.col("shared"), digest)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = keep(marked, "refined-rows")
    key = ["length", "text_sha256"]
    groups = (
        rows.where("shared")
        .groupBy(*key)
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
        .where("n > 1")
        .select(*key, "n", F.col("last.doc_id").alias("last_id"), F.col("last.row").alias("last_row"))
    )
    found = rows.join(keep(groups, "copies"), key, "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("last_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("last_row"))).alias("kept"),
        "text_sha256",
    )
