"""The citation graph, kept as an edge list.

Edges bucketed by the end that is looked up meet papers bucketed by id where both lie.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.functions.scalars import batch_time
from bibliospark.operators.lookup import Keys, lookup
from bibliospark.sources.buckets import Bucketed, through


def cited_by(
    citations: DataFrame | Bucketed,
    papers: DataFrame,
    citing_ids: Keys | None = None,
) -> DataFrame:
    """The papers each citing paper refers to, one row per edge."""
    return _ends(citations, papers, "citing_paper_id", "cited_paper_id", citing_ids)


def citing(
    citations: DataFrame | Bucketed,
    papers: DataFrame,
    cited_ids: Keys | None = None,
) -> DataFrame:
    """The papers that refer to each cited paper, one row per edge."""
    return _ends(citations, papers, "cited_paper_id", "citing_paper_id", cited_ids)


def _ends(
    citations: DataFrame | Bucketed,
    papers: DataFrame,
    start: str,
    end: str,
    starts: Keys | None,
) -> DataFrame:
    named = papers.withColumnRenamed("id", end)

    def meet(part: DataFrame) -> DataFrame:
        edges = part.select(start, end)
        if starts is not None:
            edges = lookup(edges, start, starts)
        return edges.join(named, end)

    joined = through(citations, meet)
    others = [c for c in papers.columns if c != "id"]
    return joined.select(start, F.col(end).alias("id"), *others)


def refresh_citation_counts(
    papers: DataFrame, citations: DataFrame, now: datetime | None = None
) -> DataFrame:
    """Count the incoming citations of every paper; papers without any get 0.

    Every paper counts as updated, changed or not, so that the number of rows
    touched is the number of papers. Edges are counted in part before the
    shuffle, so a paper with very many of them is no burden to one task.
    """
    counts = citations.groupBy(F.col("cited_paper_id").alias("id")).agg(F.count("*").alias("_n"))
    counted = papers.join(counts, "id", "left")
    new = {"citation_count": F.coalesce("_n", F.lit(0)), "updated_at": batch_time(now)}
    return counted.select(*(new[c].alias(c) if c in new else c for c in papers.columns))


def edge_deltas(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(``id``, ``delta``): by how much the citations of each cited paper change.

    ``added`` and ``removed`` are edges that were not there before and are
    there no more, each once; what cancels out is left out. Signs are summed in
    part before the shuffle.
    """
    signed = [
        edges.select(F.col("cited_paper_id").alias("id"), F.lit(sign).alias("sign"))
        for edges, sign in ((added, 1), (removed, -1))
        if edges is not None
    ]
    if not signed:
        raise ValueError("edge_deltas needs added or removed edges")
    every = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    sums = every.where("id IS NOT NULL").groupBy("id").agg(F.sum("sign").cast("bigint").alias("delta"))
    return sums.where("delta <> 0")


def edges_of(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """The edges that a delete of ``papers`` (``id``) takes away, each once."""
    gone = papers.select("id").distinct()
    out = citations.join(gone.withColumnRenamed("id", "citing_paper_id"), "citing_paper_id", "left_semi")
    into = citations.join(gone.withColumnRenamed("id", "cited_paper_id"), "cited_paper_id", "left_semi")
    return out.select(*citations.columns).unionByName(into.select(*citations.columns)).distinct()


def merge_citation_counts(papers: DataFrame, deltas: DataFrame, now: datetime | None = None) -> DataFrame:
    """Add ``deltas`` (``id``, ``delta``) to the stored counts.

    The counts equal those of a full refresh if they did before. Only papers
    whose count changes count as updated. An id that no paper has changes nothing.
    """
    joined = papers.join(deltas.select("id", F.col("delta").alias("_delta")), "id", "left")
    hit = F.col("_delta").isNotNull()
    new = {
        "citation_count": F.coalesce("citation_count", F.lit(0)) + F.coalesce("_delta", F.lit(0)),
        "updated_at": F.when(hit, batch_time(now)).otherwise(F.col("updated_at")),
    }
    return joined.select(*(new[c].alias(c) if c in new else c for c in papers.columns))
