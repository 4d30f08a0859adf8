"""Papers with their authors and venues, authors with their papers, conversations
with their queries.

The nested forms give one row per parent. With a ``page_size`` they come in
pages instead, one row per parent and page of at most so many elements, for
parents whose elements are too many for one array. None is cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.operators import spread
from bibliospark.operators.listing import in_time_order
from bibliospark.sources.buckets import Bucketed, through
from bibliospark.sources.durable import keep


def paper_authors(
    bridge: DataFrame | Bucketed, authors: DataFrame, min_rows: int | None = None
) -> DataFrame:
    """One row per paper and author; ``rank`` is the place by position, then author id.

    A bridge bucketed by author meets authors bucketed by id where both lie.
    """
    named = authors.withColumnRenamed("id", "author_id")
    listed = through(bridge, lambda part: part.join(named, "author_id"))
    order = [F.col("position").asc(), F.col("author_id").asc()]
    return spread.rank_within(listed, "paper_id", order, "rank", min_rows, through(bridge, lambda part: part.select("paper_id")))


def author_papers(
    bridge: DataFrame | Bucketed, papers: DataFrame, min_rows: int | None = None
) -> DataFrame:
    """One row per author and paper; ``rank`` is the place, newest year first.

    A bridge bucketed by paper meets papers bucketed by id where both lie.
    """
    named = papers.withColumnRenamed("id", "paper_id")
    listed = through(bridge, lambda part: part.select("paper_id", "author_id").join(named, "paper_id"))
    order = [F.col("year").desc_nulls_last(), F.col("paper_id").asc()]
    return spread.rank_within(listed, "author_id", order, "rank", min_rows, through(bridge, lambda part: part.select("author_id")))


def papers_with_authors(
    papers: DataFrame,
    bridge: DataFrame,
    authors: DataFrame,
    page_size: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Papers with an ``authors`` array in list order, empty where there are none."""
    return _nest(papers, paper_authors(bridge, authors, min_rows), "paper_id", "authors", page_size)


def conversations_with_queries(
    conversations: DataFrame,
    queries: DataFrame,
    page_size: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Conversations with a ``queries`` array in time order, empty where there are none."""
    listed = in_time_order(queries, "conversation_id", min_rows)
    return _nest(conversations, listed, "conversation_id", "queries", page_size)


def papers_with_venue(papers: DataFrame, venues: DataFrame) -> DataFrame:
    """Papers with a ``venue`` struct, NULL where there is none."""
    venue = venues.select(F.col("id").alias("venue_id"), F.struct(*venues.columns).alias("venue"))
    return papers.join(venue, "venue_id", "left").select(*papers.columns, "venue")


def _nest(
    parents: DataFrame, elements: DataFrame, key: str, name: str, page_size: int | None
) -> DataFrame:
    """Collect ranked elements into arrays or pages and attach them to their parents."""
    page = F.lit(0) if page_size is None else F.expr(f"(rank - 1) div {page_size}")
    fields = ["rank", *(c for c in elements.columns if c not in ("rank", key))]
    pages = (
        elements.groupBy(F.col(key).alias("id"), page.cast("bigint").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    )
    kind = pages.schema[name].dataType
    if page_size is None:
        nested = parents.join(pages, "id", "left")
    else:
        # a parent of very many pages is split if its pages are the left side of an inner join
        stored = keep(pages, "pages")
        alone = parents.join(stored.select("id"), "id", "left_anti")
        nested = stored.join(parents, "id").unionByName(alone, allowMissingColumns=True)
    return nested.select(
        *parents.columns,
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce(name, F.array().cast(kind)).alias(name),
    )
