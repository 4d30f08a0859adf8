"""Sorted lists, work queues and recency lists.

Ties are always broken by id. A negative limit means no limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.operators.lookup import Keys, lookup
from bibliospark.operators.spread import rank_within

QUEUE_LIMIT = 100
CONVERSATION_LIMIT = 50


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df if limit < 0 else df.limit(limit)


def list_venues(venues: DataFrame) -> DataFrame:
    """All venues by name, in byte order."""
    return venues.orderBy("name")


def papers_in_status(papers: DataFrame, status: str, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The work queue of a status: its papers, oldest first."""
    waiting = papers.where(F.col("status") == status)
    return _limited(waiting.orderBy(F.col("created_at").asc_nulls_first(), "id"), limit)


def oldest_per_status(papers: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The work queues of all statuses at once, with the place in the queue as ``rank``.

    With a limit, each task keeps ``limit`` rows per status before the
    shuffle, so that few statuses over many papers stay cheap.
    """
    known = papers.where(F.col("status").isNotNull())
    oldest_first = [F.col("created_at").asc_nulls_first(), F.col("id").asc()]
    if limit < 0:
        return rank_within(known, "status", oldest_first)
    queue = Window.partitionBy("status").orderBy(*oldest_first)
    ranked = known.withColumn("rank", F.row_number().over(queue))
    return ranked.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("bigint"))


def recent_conversations(conversations: DataFrame, limit: int = CONVERSATION_LIMIT) -> DataFrame:
    """Conversations, the latest active first."""
    return _limited(conversations.orderBy(F.col("updated_at").desc_nulls_last(), "id"), limit)


def conversation_queries(
    queries: DataFrame, conversation_ids: Keys | None = None, min_rows: int | None = None
) -> DataFrame:
    """Queries of conversations with their place in time order as ``rank``."""
    return _entries(queries, "conversation_id", conversation_ids, min_rows)


def paper_log(
    processing_log: DataFrame, paper_ids: Keys | None = None, min_rows: int | None = None
) -> DataFrame:
    """Log entries of papers with their place in time order as ``rank``."""
    return _entries(processing_log, "paper_id", paper_ids, min_rows)


def _entries(entries: DataFrame, key: str, keys: Keys | None, min_rows: int | None) -> DataFrame:
    wanted = entries if keys is None else lookup(entries, key, keys)
    return in_time_order(wanted, key, min_rows)


def in_time_order(entries: DataFrame, key: str, min_rows: int | None = None) -> DataFrame:
    """Number the entries of each key by time; entries without a key are left out."""
    order = [F.col("created_at").asc_nulls_first(), F.col("id").asc()]
    return rank_within(entries.where(F.col(key).isNotNull()), key, order, "rank", min_rows)
