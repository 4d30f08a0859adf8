"""The two append-only feeds as streams over the driver's event file."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliospark.plans.base import NOW, NOW_SQL, query
from bibliospark.plans.writes import LOG_BATCH, log_batch, log_papers
from bibliospark.sources.durable import new_path
from bibliospark.streaming import feeds


def _events(spark, folder):
    """The event file as a stream; the pattern lets more files join it."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")


@query(
    "watch_conversations",
    "SELECT user_id AS conversation_id, max(ts) AS updated_at FROM events GROUP BY user_id",
)
def watch_conversations(spark, folder):
    asked = _events(spark, folder).select(
        F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at")
    )
    out = new_path(spark, "activity")
    feeds.watch_conversations(asked, f"{out}/rows", f"{out}/state").awaitTermination()
    return feeds.read_activity(spark, f"{out}/rows")


@query(
    "count_activity",
    """SELECT user_id AS conversation_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n_queries, max(ts) AS last_at
       FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2""",
)
def count_activity(spark, folder):
    asked = _events(spark, folder).select(
        F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at")
    )
    out = new_path(spark, "counts")
    feeds.count_activity(asked, f"{out}/rows", f"{out}/state").awaitTermination()
    return feeds.read_counts(spark, f"{out}/rows")


def _ingest_log(spark, folder, part):
    out = new_path(spark, "log")
    entries = log_batch(_events(spark, folder))
    feeds.ingest_log(
        entries, log_papers(spark, folder), f"{out}/rows", f"{out}/state", 77, NOW
    ).awaitTermination()
    return feeds.read_log(spark, f"{out}/rows", part)


@query(
    "ingest_log",
    f"""SELECT 77 + row_number() OVER (ORDER BY seq) AS id, paper_id, stage, status, message, {NOW_SQL} AS created_at
        FROM v_log WHERE reason IS NULL""",
    LOG_BATCH,
)
def ingest_log(spark, folder):
    return _ingest_log(spark, folder, "accepted")


@query(
    "ingest_log_rejected",
    "SELECT seq, reason, key, 'integrity' AS reported_as FROM v_log WHERE reason IS NOT NULL",
    LOG_BATCH,
)
def ingest_log_rejected(spark, folder):
    return _ingest_log(spark, folder, "rejected")
