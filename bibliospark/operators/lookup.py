"""Keyed reads: one value, a list of values, or a DataFrame of values.

A value nobody has gives no row. Text compares case-sensitively and a NULL
value matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Keys = DataFrame | Iterable | int | str

#: A table of at most so many keys may become a filter.
POINT_READS = 1_000


def _typed(keys: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The only column of ``keys`` with the name and the type of the table's."""
    return keys.toDF(column).select(F.col(column).cast(table.schema[column].dataType))


def lookup(table: DataFrame, column: str, keys: Keys) -> DataFrame:
    """Rows of ``table`` whose ``column`` is one of ``keys``.

    Values in hand become a filter that reaches the scan; a DataFrame, with
    the keys in its only column, becomes a semi join, which needs no distinct
    keys; adaptive execution splits what a heavy key makes large.
    """
    if isinstance(keys, DataFrame):
        return table.join(_typed(keys, table, column), column, "left_semi").select(*table.columns)
    if isinstance(keys, (int, str)):
        return table.where(F.col(column) == keys)
    return table.where(F.col(column).isin(list(keys)))


def point_lookup(table: DataFrame, column: str, keys: DataFrame, most: int = POINT_READS) -> DataFrame:
    """As :func:`lookup` with the keys of a DataFrame, for few keys over a stored table.

    Up to ``most`` keys are fetched and become a filter, which reaches the scan:
    row groups whose bounds or bloom filters exclude all keys are skipped.
    More keys stay a semi join.
    """
    typed = _typed(keys, table, column).where(F.col(column).isNotNull())
    first = [r[0] for r in typed.limit(most + 1).collect()]
    return lookup(table, column, keys if len(first) > most else sorted(set(first)))


def venues_by_id(venues: DataFrame, ids: Keys) -> DataFrame:
    return lookup(venues, "id", ids)


def venues_by_name(venues: DataFrame, names: Keys) -> DataFrame:
    return lookup(venues, "name", names)


def authors_by_id(authors: DataFrame, ids: Keys) -> DataFrame:
    return lookup(authors, "id", ids)


def authors_by_name(authors: DataFrame, normalized_names: Keys) -> DataFrame:
    """The caller normalises: the names are compared as they are."""
    return lookup(authors, "name_normalized", normalized_names)


def papers_by_id(papers: DataFrame, ids: Keys) -> DataFrame:
    return lookup(papers, "id", ids)


def papers_by_arxiv_id(papers: DataFrame, arxiv_ids: Keys) -> DataFrame:
    return lookup(papers, "arxiv_id", arxiv_ids)


def papers_by_doi(papers: DataFrame, dois: Keys) -> DataFrame:
    return lookup(papers, "doi", dois)


def conversations_by_id(conversations: DataFrame, ids: Keys) -> DataFrame:
    return lookup(conversations, "id", ids)


def queries_by_id(queries: DataFrame, ids: Keys) -> DataFrame:
    return lookup(queries, "id", ids)


def papers_by_venue(papers: DataFrame, venue_ids: Keys) -> DataFrame:
    return lookup(papers, "venue_id", venue_ids)


def papers_by_year(papers: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Papers of one year, or of the years from ``first`` to ``last``."""
    return papers.where(F.col("year").between(first, first if last is None else last))


def embedded_papers(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("embedding_model").isNotNull())
