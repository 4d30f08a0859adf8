"""Batch inserts.

Every insert takes a batch with an order column (``seq`` by default), the
present tables and the largest id given out so far, and returns the rows to
add and the rows refused: ``seq``, ``reason``, ``key`` and ``reported_as``,
which is what a one-row insert would have called the failure. A row without an
order value, or with one that another row has too, is refused (``order_null``,
``order_repeated``), so every row ends in one of the two. An ``id`` in the
batch is ignored. Time stamps in the batch are kept, for loading history;
without such columns all rows get the batch time.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.functions.scalars import batch_time, name_key
from bibliospark.operators import spread
from bibliospark.operators.changes import touch_conversations
from bibliospark.operators.ids import assign_ids
from bibliospark.operators.outcomes import (
    Links,
    Outcome,
    PapersOutcome,
    QueriesOutcome,
    ResolvedAuthors,
)
from bibliospark.operators.integrity import conform, judge, split_order
from bibliospark.schemas import DEFAULT_VENUES, RULES, TABLES
from bibliospark.sources.durable import keep


def _finish(rows: DataFrame, table: str, now: datetime | None) -> DataFrame:
    """Fill absent columns with their defaults and put all in table order.

    A column that is there but NULL stays NULL, as an explicit NULL does.
    """
    defaults = RULES[table].defaults
    stamps = {"created_at", "updated_at"}
    columns = []
    for f in TABLES[table].fields:
        if f.name in rows.columns:
            value = F.col(f.name)
        elif f.name in defaults:
            value = F.lit(defaults[f.name])
        elif f.name in stamps:
            value = batch_time(now)
        elif f.dataType.typeName() == "array":
            value = F.array()
        else:
            value = F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def _with_defaults(batch: DataFrame, table: str) -> DataFrame:
    """Add absent columns that have a default, so that the rules see them."""
    absent = {c: v for c, v in RULES[table].defaults.items() if c not in batch.columns}
    return batch.withColumns({c: F.lit(v) for c, v in absent.items()}) if absent else batch


def _insert(
    batch: DataFrame,
    table: str,
    order: str,
    above: int,
    now: datetime | None,
    target: DataFrame | None = None,
    parents: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows with their ``id`` and the order column, the two alone, and the verdicts."""
    batch, refused = split_order(_with_defaults(batch.drop("id"), table), order)
    typed, type_checks = conform(batch, TABLES[table])
    verdicts = judge(batch, order, RULES[table], target, parents, type_checks).unionByName(refused)
    ids = assign_ids(verdicts.where(F.col("reason").isNull()).select(order), [order], above)
    return typed.join(ids, order), ids, verdicts


def _rejects(verdicts: DataFrame, order: str, duplicate_only: bool = False) -> DataFrame:
    reported = F.lit("duplicate") if duplicate_only else F.when(
        F.col("reason") == "duplicate", F.col("reason")
    ).otherwise(F.lit("integrity"))
    return verdicts.where(F.col("reason").isNotNull()).select(
        order, "reason", "key", reported.alias("reported_as")
    )


def insert_venues(
    batch: DataFrame, venues: DataFrame, above: int, now: datetime | None = None, order: str = "seq"
) -> Outcome:
    """Add venues; names are unique."""
    rows, _, verdicts = _insert(batch, "venues", order, above, now, venues)
    return Outcome(_finish(rows, "venues", now), _rejects(verdicts, order))


def seed_venues(venues: DataFrame, above: int, now: datetime | None = None) -> DataFrame:
    """The venues with the default ones added whose names are missing."""
    seeds = [(at, *row) for at, row in enumerate(DEFAULT_VENUES)]
    batch = venues.sparkSession.createDataFrame(
        seeds, "seq bigint, name string, type string, url string"
    )
    return venues.unionByName(insert_venues(batch, venues, above, now).accepted)


def with_name_key(batch: DataFrame) -> DataFrame:
    """Give every author row its ``name_normalized``."""
    given = F.col("name_normalized") if "name_normalized" in batch.columns else None
    return batch.withColumn("name_normalized", name_key(F.col("name"), given))


def insert_authors(
    batch: DataFrame, authors: DataFrame, above: int, now: datetime | None = None, order: str = "seq"
) -> Outcome:
    """Add authors; normalised names are unique."""
    rows, _, verdicts = _insert(with_name_key(batch), "authors", order, above, now, authors)
    return Outcome(_finish(rows, "authors", now), _rejects(verdicts, order))


def resolve_authors(
    mentions: DataFrame,
    authors: DataFrame,
    above: int,
    now: datetime | None = None,
    order: tuple[str, ...] = ("seq", "position"),
) -> ResolvedAuthors:
    """Give each mention of an author an ``author_id``, making missing authors.

    A known author keeps the stored spelling and affiliations; of an unknown
    one the first mention in ``order`` counts. A mention without a name gets
    no id.
    """
    mentions = with_name_key(mentions)
    names = mentions.select("name_normalized").distinct()
    known = authors.select("name_normalized", F.col("id").alias("author_id")).join(
        names, "name_normalized", "left_semi"
    )
    marked = keep(spread.join(mentions, known, "name_normalized", "left"), "mentions")
    is_unknown = F.col("author_id").isNull() & F.col("name_normalized").isNotNull()
    unknown = marked.where(is_unknown).drop("author_id")
    first = F.struct(*order)
    details = [c for c in ("name", "affiliations") if c in mentions.columns]
    firsts = unknown.groupBy("name_normalized").agg(
        F.min_by(F.struct(*details), first).alias("_author"), F.min(first).alias("_first")
    )
    created = assign_ids(firsts, [f"_first.{c}" for c in order], above)
    made = created.select("name_normalized", F.col("id").alias("author_id"))
    resolved = marked.where(~is_unknown).unionByName(
        spread.join(unknown, made, "name_normalized", "inner")
    )
    added = created.select("id", "name_normalized", "_author.*")
    return ResolvedAuthors(resolved, _finish(added, "authors", now))


def insert_papers(
    batch: DataFrame,
    papers: DataFrame,
    authors: DataFrame,
    venues: DataFrame,
    above_papers: int,
    above_authors: int,
    author_lists: DataFrame | None = None,
    now: datetime | None = None,
    order: str = "seq",
) -> PapersOutcome:
    """Add papers with their ordered author lists.

    ``author_lists`` has one row per author of a paper: the paper's order
    value, a 1-based ``position``, ``name`` and optionally ``name_normalized``
    and ``affiliations`` (``functions.scalars.element_positions`` makes it from
    an array column). A batch without such lists adds papers only. Authors of
    refused papers are not made. An author listed twice is linked at the first
    position; the repeat is refused.
    """
    rows, ids, verdicts = _insert(
        batch, "papers", order, above_papers, now, papers, {"venues": venues}
    )
    link = partial(_link_authors, ids, authors, above_authors, author_lists, now, order)
    return PapersOutcome(_finish(rows, "papers", now), _rejects(verdicts, order), link)


def _link_authors(
    ids: DataFrame,
    authors: DataFrame,
    above: int,
    author_lists: DataFrame | None,
    now: datetime | None,
    order: str,
) -> Links:
    """Resolve the author lists of accepted papers (``ids``) to authors and links."""
    if author_lists is None:
        spark = authors.sparkSession
        return Links(
            spark.createDataFrame([], TABLES["authors"]),
            spark.createDataFrame([], TABLES["paper_authors"]),
            spark.createDataFrame([], f"{order} bigint, position int, reason string, key string"),
        )
    paper_ids = ids.select(order, F.col("id").alias("paper_id"))
    # a mention is told by its own number: the same author may stand twice at one position
    numbered = author_lists.drop("id").withColumn("_mention", F.monotonically_increasing_id())
    # read several times below: the join is made and the names are normalised once
    listed = keep(with_name_key(keep(numbered, "author-lists").join(paper_ids, order)), "listed-authors")
    lacking = F.when(F.col("name").isNull(), "name").when(F.col("position").isNull(), "position")
    resolved = resolve_authors(
        listed.where(lacking.isNull()), authors, above, now, (order, "position", "_mention")
    )
    links = resolved.mentions.select(
        order, "paper_id", "author_id", F.col("position").cast("int"), "_mention"
    )
    first = F.min(F.struct("position", "_mention")).alias("first")
    bridge = links.groupBy("paper_id", "author_id").agg(first).select(
        "paper_id", "author_id", "first.position", "first._mention"
    )
    repeats = links.join(bridge, "_mention", "left_anti").select(
        order, "position", F.lit("duplicate").alias("reason"), F.lit("paper_id,author_id").alias("key")
    )
    nameless = listed.where(lacking.isNotNull()).select(
        order, F.col("position").cast("int"), F.lit("not_null").alias("reason"), lacking.alias("key")
    )
    return Links(
        resolved.added,
        bridge.select("paper_id", "author_id", "position"),
        repeats.unionByName(nameless),
    )


def insert_citations(
    batch: DataFrame,
    citations: DataFrame,
    papers: DataFrame,
    now: datetime | None = None,
    order: str = "seq",
) -> Outcome:
    """Add citation edges; every refusal is reported as a duplicate."""
    batch, unordered = split_order(batch, order)
    typed, type_checks = conform(batch, TABLES["citations"])
    verdicts = judge(
        batch, order, RULES["citations"], citations, {"papers": papers}, type_checks
    ).unionByName(unordered)
    refused = verdicts.where(F.col("reason").isNotNull())
    rows = typed.join(refused.select(order), order, "left_anti")
    return Outcome(_finish(rows, "citations", now), _rejects(verdicts, order, duplicate_only=True))


def insert_links(
    batch: DataFrame,
    paper_authors: DataFrame,
    papers: DataFrame,
    authors: DataFrame,
    order: str = "seq",
) -> Outcome:
    """Add paper-author links; a pair is unique and both ends must exist."""
    batch, unordered = split_order(batch, order)
    typed, type_checks = conform(batch, TABLES["paper_authors"])
    verdicts = judge(
        batch,
        order,
        RULES["paper_authors"],
        paper_authors,
        {"papers": papers, "authors": authors},
        type_checks,
    ).unionByName(unordered)
    refused = verdicts.where(F.col("reason").isNotNull())
    rows = typed.join(refused.select(order), order, "left_anti")
    return Outcome(_finish(rows, "paper_authors", None), _rejects(verdicts, order))


def insert_conversations(
    batch: DataFrame, above: int, now: datetime | None = None, order: str = "seq"
) -> DataFrame:
    """Open conversations; the title may be NULL or absent."""
    typed, _ = conform(batch.drop("id"), TABLES["conversations"])
    return _finish(assign_ids(typed, [order], above), "conversations", now)


def insert_queries(
    batch: DataFrame,
    conversations: DataFrame,
    above: int,
    now: datetime | None = None,
    order: str = "seq",
) -> QueriesOutcome:
    """Add queries and the next snapshot of the conversations they touch."""
    rows, _, verdicts = _insert(
        batch, "queries", order, above, now, None, {"conversations": conversations}
    )
    accepted = _finish(rows, "queries", now)
    return QueriesOutcome(
        accepted, _rejects(verdicts, order), touch_conversations(conversations, accepted)
    )


def append_log(
    batch: DataFrame,
    papers: DataFrame,
    above: int,
    now: datetime | None = None,
    order: str = "seq",
) -> Outcome:
    """Append processing-log entries."""
    rows, _, verdicts = _insert(
        batch, "processing_log", order, above, now, None, {"papers": papers}
    )
    return Outcome(_finish(rows, "processing_log", now), _rejects(verdicts, order))
