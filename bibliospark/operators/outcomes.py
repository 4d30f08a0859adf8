"""What the batch operators return."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame


class Outcome(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


class Links(NamedTuple):
    """What the author lists of accepted papers add, and their refused entries."""

    authors: DataFrame
    paper_authors: DataFrame
    rejected: DataFrame


class PapersOutcome:
    """What a batch of papers adds, table by table, and what it was refused.

    Author lists are resolved when the first of ``authors``, ``paper_authors``
    and ``rejected_links`` is asked for.
    """

    def __init__(self, papers: DataFrame, rejected: DataFrame, link: Callable[[], Links]):
        self.papers = papers
        self.rejected = rejected
        self._link = link

    @cached_property
    def _links(self) -> Links:
        return self._link()

    @property
    def authors(self) -> DataFrame:
        return self._links.authors

    @property
    def paper_authors(self) -> DataFrame:
        return self._links.paper_authors

    @property
    def rejected_links(self) -> DataFrame:
        return self._links.rejected


class ResolvedAuthors(NamedTuple):
    """Mentions with their ``author_id``, and the authors that had to be made."""

    mentions: DataFrame
    added: DataFrame


class QueriesOutcome(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    conversations: DataFrame | None
