"""Live conversation activity and processing-log ingest on Structured Streaming.

All write one folder per micro-batch, named by its number and overwritten
when the batch is replayed, so a restart repeats no row. A mark is written
when all of a batch is there; readers see marked batches only. Feeds with
state keep it for as long as rows may be late, by event time, and no longer.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bibliospark.operators.ingest import append_log
from bibliospark.schemas import TABLES

# Batches of activity between two snapshots; a reader opens at most so many folders.
COMPACT_EVERY = 20
EPOCH = "1970-01-01 00:00:00"


def watch_conversations(queries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the time of the newest query of each conversation.

    ``queries`` is a stream with ``conversation_id`` and ``created_at``. A
    maximum needs no state: each micro-batch writes its own maxima, and every
    ``COMPACT_EVERY`` batches these are merged into a snapshot. Folders older
    than the newest snapshot may be deleted. Runs until all input at hand is read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = (
            batch.where(F.col("conversation_id").isNotNull())
            .groupBy("conversation_id")
            .agg(F.max("created_at").alias("updated_at"))
        )
        _write_maxima(newest, out, batch_id, ["conversation_id"])

    return (
        queries.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_activity(
    queries: DataFrame, out: str, checkpoint: str, late: str = "1 hour", hours: int = 1
) -> StreamingQuery:
    """Count the queries of each conversation by windows of event time, with their newest time.

    A count needs state: a window is kept in the state store until the newest
    event is ``late`` after its end, then evicted. A row may come out of order
    by that much; a later one is not counted, and the query's progress tells
    how many there were. Each micro-batch writes the windows that changed, so
    the counts at hand can be read at any time. Runs until all input at hand is read.
    """
    since = F.lit(EPOCH).cast("timestamp_ntz")
    stamped = queries.where("conversation_id IS NOT NULL AND created_at IS NOT NULL").select(
        "conversation_id", _instant("created_at").alias("at")
    )
    counted = (
        stamped.withWatermark("at", late)
        .groupBy(F.window("at", f"{hours} hours").alias("span"), "conversation_id")
        .agg(F.count("*").alias("n_queries"), F.max("at").alias("last_at"))
    )
    plain = counted.select(
        "conversation_id",
        F.timestamp_add("MICROSECOND", F.unix_micros("span.start"), since).alias("window_start"),
        "n_queries",
        F.timestamp_add("MICROSECOND", F.unix_micros("last_at"), since).alias("last_at"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_maxima(batch, out, batch_id, ["conversation_id", "window_start"])

    return (
        plain.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _instant(column: str) -> Column:
    """A time stamp without a zone as the instant at which it is that time in UTC, in any session."""
    since = F.lit(EPOCH).cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", since, F.col(column)))


def _write_maxima(rows: DataFrame, out: str, batch_id: int, keys: list[str]) -> None:
    """Write a batch of maxima per key, merge it into a snapshot when one is due, and mark the batch."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
    if (batch_id + 1) % COMPACT_EVERY == 0:
        merged = _maxima(spark, out, batch_id - COMPACT_EVERY, range(batch_id - COMPACT_EVERY + 1, batch_id + 1), keys, rows.schema)
        merged.write.mode("overwrite").parquet(f"{out}/snapshot/batch={batch_id}")
    _mark(spark, out, batch_id)


def _mark(spark: SparkSession, out: str, batch_id: int) -> None:
    spark.range(1).select(F.lit(batch_id).alias("done")).coalesce(1).write.mode("overwrite").parquet(
        f"{out}/marks/batch={batch_id}"
    )


def _last_mark(spark: SparkSession, out: str) -> int:
    """The newest batch that is written whole, -1 if there is none yet."""
    try:
        marks = spark.read.parquet(f"{out}/marks")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    return marks.agg(F.max("batch")).first()[0]


def _maxima(
    spark: SparkSession, out: str, snapshot: int, batches: Iterable[int], keys: list[str], schema: T.StructType
) -> DataFrame:
    """The maxima over a snapshot, if its number is not negative, and the batches after it."""
    paths = [f"{out}/changes/batch={n}" for n in batches]
    if snapshot >= 0:
        paths.append(f"{out}/snapshot/batch={snapshot}")
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in schema.fieldNames() if c not in keys))


def _read_maxima(spark: SparkSession, out: str, keys: list[str], columns: str) -> DataFrame:
    schema = T.StructType.fromDDL(columns)
    last = _last_mark(spark, out)
    if last < 0:
        return spark.createDataFrame([], schema)
    snapshot = (last + 1) // COMPACT_EVERY * COMPACT_EVERY - 1
    return _maxima(spark, out, snapshot, range(snapshot + 1, last + 1), keys, schema)


def read_activity(spark: SparkSession, out: str) -> DataFrame:
    """The activity written so far: the newest time of each conversation. Empty before the first batch."""
    return _read_maxima(spark, out, ["conversation_id"], "conversation_id bigint, updated_at timestamp_ntz")


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts written so far by conversation and window. Empty before the first batch."""
    columns = "conversation_id bigint, window_start timestamp_ntz, n_queries bigint, last_at timestamp_ntz"
    return _read_maxima(spark, out, ["conversation_id", "window_start"], columns)


def ingest_log(
    entries: DataFrame,
    papers: DataFrame,
    out: str,
    checkpoint: str,
    above: int = 0,
    now: datetime | None = None,
    order: str = "seq",
) -> StreamingQuery:
    """Append a stream of log entries, splitting off those the rules refuse.

    Accepted rows go to ``accepted``, refused ones to ``rejected``. The ids of
    a micro-batch start above those of the batches before it, which its
    replay reads again, so that it gives out the same ids.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _append(batch, papers, out, batch_id, above, now, order)

    return (
        entries.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _append(
    batch: DataFrame, papers: DataFrame, out: str, batch_id: int, above: int, now: datetime | None, order: str
) -> None:
    """Judge a micro-batch of log entries and write both its parts and its mark."""
    spark = batch.sparkSession
    start = _last_id(spark, out, batch_id - 1) if batch_id else above
    outcome = append_log(batch, papers, start, now, order)
    accepted = f"{out}/accepted/batch={batch_id}"
    outcome.accepted.write.mode("overwrite").parquet(accepted)
    outcome.rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
    newest = F.coalesce(F.max("id"), F.lit(start)).alias("last_id")
    mark = spark.read.parquet(accepted).agg(newest)
    mark.write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")


def settle_log(
    entries: DataFrame,
    arrivals: DataFrame,
    papers: DataFrame,
    out: str,
    checkpoint: str,
    patience: str = "1 hour",
    memory: str = "1 hour",
    late: str = "10 minutes",
    above: int = 0,
    now: datetime | None = None,
    order: str = "seq",
) -> StreamingQuery:
    """As :func:`ingest_log`, for entries that may come before the paper they name.

    ``papers`` are stored already; ``arrivals`` is a stream of new ones, ``id``
    (each once) and ``created_at``. An entry about a stored paper, or about
    none, is judged at once. Any other is held in the state store and meets, in
    a stream-to-stream outer join, the papers that arrive at most ``memory``
    before and ``patience`` after its ``created_at``. When the watermarks of both streams, ``late``
    behind their newest events, have passed that time, it is refused for its foreign
    key. Both sides' state is evicted by these bounds. Runs until all input at hand is read.
    """
    spark = entries.sparkSession
    columns = entries.columns
    known = papers.select(F.col("id").alias("paper_id")).distinct().withColumn("known", F.lit(True))
    flagged = entries.join(known, "paper_id", "left")
    at_once = flagged.where("known OR paper_id IS NULL OR created_at IS NULL")
    waiting = flagged.where("known IS NULL AND paper_id IS NOT NULL AND created_at IS NOT NULL")
    held = waiting.select(*columns, _instant("created_at").alias("asked_at")).withWatermark("asked_at", late)
    came = arrivals.where("id IS NOT NULL AND created_at IS NOT NULL").select(
        F.col("id").cast("bigint").alias("arrived_id"), _instant("created_at").alias("arrived_at")
    ).withWatermark("arrived_at", late)
    meets = F.expr(
        f"paper_id = arrived_id AND arrived_at >= asked_at - INTERVAL {memory} AND arrived_at <= asked_at + INTERVAL {patience}"
    )
    settled = held.join(came, meets, "left_outer").select(*columns, F.col("arrived_id").alias("parent"))
    judged = at_once.select(*columns, F.when(F.col("known"), F.col("paper_id")).cast("bigint").alias("parent")).unionByName(settled)

    def write(batch: DataFrame, batch_id: int) -> None:
        # read once: the state of the join must not be worked out again for each use of the batch
        batch.write.mode("overwrite").parquet(f"{out}/settled/batch={batch_id}")
        rows = spark.read.schema(judged.schema).parquet(f"{out}/settled/batch={batch_id}")
        parents = rows.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
        _append(rows.drop("parent"), parents, out, batch_id, above, now, order)

    return (
        judged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _last_id(spark, out: str, batch_id: int) -> int:
    """The largest id given out up to the end of a batch."""
    return spark.read.parquet(f"{out}/marks/batch={batch_id}").first()["last_id"]


def read_log(spark, out: str, part: str = "accepted") -> DataFrame:
    """The rows of ``accepted`` or ``rejected`` in batches that are written whole. Empty before the first."""
    last = _last_mark(spark, out)
    if last < 0:
        refused = "reason string, key string, reported_as string"
        return spark.createDataFrame([], TABLES["processing_log"] if part == "accepted" else T.StructType.fromDDL(refused))
    rows = spark.read.option("basePath", f"{out}/{part}").parquet(f"{out}/{part}")
    return rows.where(F.col("batch") <= last).drop("batch")
