"""Updates and deletes as transforms from one snapshot to the next.

Changes to one id apply in the order of the batch, so the last one stays; one
without an order value comes before all others, and of several with the same
value the one that sets the largest value stays. Unknown ids change nothing. Callers write the result to a new place.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.functions.scalars import batch_time
from bibliospark.operators.outcomes import Outcome
from bibliospark.schemas import PAPER_STATUSES
from bibliospark.sources.durable import keep


class Cascade(NamedTuple):
    """The tables after a delete, by name, and the ids that were there and went."""

    tables: dict[str, DataFrame]
    deleted: DataFrame


class VenueDelete(NamedTuple):
    venues: DataFrame
    deleted: DataFrame
    rejected: DataFrame


def _last(changes: DataFrame, value: str, order: str) -> DataFrame:
    """The last change of each id; many changes of one id shrink before the shuffle."""
    newest = F.max_by(F.struct(F.col(value).alias("value")), F.struct(F.col(order), F.col(value)))
    return changes.groupBy(F.col("id").cast("bigint").alias("id")).agg(newest.alias("_new"))


def _apply(
    table: DataFrame, changes: DataFrame, value: str, order: str, new: dict[str, Column]
) -> DataFrame:
    """Set ``new`` columns on the rows that a change names; ``_new.value`` is its value."""
    joined = table.join(_last(changes, value, order), "id", "left")
    hit = F.col("_new").isNotNull()
    return joined.select(
        *(
            F.when(hit, new[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
            if c in new
            else c
            for c in table.columns
        )
    )


def set_affiliations(authors: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Replace the affiliation lists: ``id``, ``affiliations``."""
    return _apply(
        authors, changes, "affiliations", order, {"affiliations": F.col("_new.value")}
    )


def set_status(
    papers: DataFrame, changes: DataFrame, now: datetime | None = None, order: str = "seq"
) -> Outcome:
    """Set ``status`` of papers: ``id``, ``status``. Any known status may follow any other.

    The new snapshot is ``accepted``; changes to an unknown status are
    refused if their paper exists, as an update of no row breaks no rule.
    """
    allowed = F.col("status").isNull() | F.col("status").isin(*PAPER_STATUSES)
    after = _apply(
        papers,
        changes.where(allowed),
        "status",
        order,
        {"status": F.col("_new.value"), "updated_at": batch_time(now)},
    )
    bad = changes.where(~allowed).withColumn("id", F.col("id").cast("bigint"))
    refused = bad.join(papers.select("id"), "id", "left_semi")
    return Outcome(
        after,
        refused.select(
            order,
            F.lit("check").alias("reason"),
            F.lit("status").alias("key"),
            F.lit("integrity").alias("reported_as"),
        ),
    )


def set_full_text(
    papers: DataFrame, changes: DataFrame, now: datetime | None = None, order: str = "seq"
) -> DataFrame:
    """Store extracted text, ``id``, ``full_text``, which makes the status ``extracted``."""
    new = {
        "full_text": F.col("_new.value"),
        "status": F.lit("extracted"),
        "updated_at": batch_time(now),
    }
    return _apply(papers, changes, "full_text", order, new)


def mark_embedded(
    papers: DataFrame, changes: DataFrame, now: datetime | None = None, order: str = "seq"
) -> DataFrame:
    """Record the embedding model, ``id``, ``embedding_model``; the paper is then ``ready``."""
    new = {
        "embedding_model": F.col("_new.value"),
        "embedded_at": batch_time(now),
        "status": F.lit("ready"),
        "updated_at": batch_time(now),
    }
    return _apply(papers, changes, "embedding_model", order, new)


def touch_papers(papers: DataFrame, ids: DataFrame, now: datetime | None = None) -> DataFrame:
    """Set ``updated_at`` of the papers an update names."""
    return _touch(papers, ids.select("id").distinct().withColumn("_at", batch_time(now)))


def touch_conversations(conversations: DataFrame, queries: DataFrame) -> DataFrame:
    """Move ``updated_at`` of each conversation up to the time of its newest added query, never back."""
    newest = (
        queries.where(F.col("conversation_id").isNotNull())
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.max("created_at").alias("_at"))
    )
    return _touch(conversations, newest)


def _touch(table: DataFrame, stamps: DataFrame) -> DataFrame:
    joined = table.join(stamps, "id", "left")
    return joined.select(
        *(F.greatest("_at", c).alias(c) if c == "updated_at" else c for c in table.columns)
    )


def _ids(ids: DataFrame) -> DataFrame:
    """The ids to delete, stored, so that every table of a cascade sees the same ones."""
    return keep(ids.select(F.col("id").cast("bigint")).where("id is not null").distinct(), "deleted")


def _without(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("id").alias(column))
    return table.join(gone, column, "left_anti").select(*table.columns)


def delete_papers(
    ids: DataFrame,
    papers: DataFrame,
    paper_authors: DataFrame,
    citations: DataFrame,
    processing_log: DataFrame,
) -> Cascade:
    """Delete papers with their links, their citations on both sides and their log.

    Citation counts of papers they cited stay as they are until the next
    refresh, and retrieved-id lists of queries may still name them.
    """
    gone = _ids(ids)
    edges = _without(citations, "citing_paper_id", gone)
    return Cascade(
        {
            "papers": papers.join(gone, "id", "left_anti"),
            "paper_authors": _without(paper_authors, "paper_id", gone),
            "citations": _without(edges, "cited_paper_id", gone),
            "processing_log": _without(processing_log, "paper_id", gone),
        },
        papers.select("id").join(gone, "id", "left_semi"),
    )


def delete_conversations(
    ids: DataFrame, conversations: DataFrame, queries: DataFrame
) -> Cascade:
    """Delete conversations with their queries."""
    gone = _ids(ids)
    return Cascade(
        {
            "conversations": conversations.join(gone, "id", "left_anti"),
            "queries": _without(queries, "conversation_id", gone),
        },
        conversations.select("id").join(gone, "id", "left_semi"),
    )


def delete_authors(
    ids: DataFrame, authors: DataFrame, paper_authors: DataFrame
) -> Cascade:
    """Delete authors with their links."""
    gone = _ids(ids)
    return Cascade(
        {
            "authors": authors.join(gone, "id", "left_anti"),
            "paper_authors": _without(paper_authors, "author_id", gone),
        },
        authors.select("id").join(gone, "id", "left_semi"),
    )


def delete_venues(ids: DataFrame, venues: DataFrame, papers: DataFrame) -> VenueDelete:
    """Delete venues; one that a paper names is refused."""
    asked = venues.select("id").join(_ids(ids), "id", "left_semi")
    used = papers.select(F.col("venue_id").alias("id")).where("id is not null").distinct()
    refused = asked.join(used, "id", "left_semi")
    deleted = keep(asked.join(used, "id", "left_anti"), "deleted-venues")
    return VenueDelete(
        venues.join(deleted, "id", "left_anti"),
        deleted,
        refused.select("id", F.lit("foreign_key").alias("reason"), F.lit("venue_id").alias("key")),
    )
