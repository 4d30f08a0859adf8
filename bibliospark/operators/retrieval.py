"""Top-k retrieval by cosine similarity, exact and approximate.

No pair of a query and a vector becomes a row: tasks multiply blocks of
vectors and give out at most k matches per query and block. The exact form
compares every query with every corpus vector that could be among its best;
the approximate one looks into the cells around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.operators import cells

TOP_K = 10
MIN_SIMILARITY = 0.5
# The query block may be sent to every task up to this size. Beyond it queries
# visit blocks of the corpus.
BROADCAST_BYTES = 64 * 1024 * 1024
# What a row takes on the driver besides its components.
ROW_BYTES = 200
# The share of true neighbours that an approximate search aims for.
RECALL = 0.95


class Found(NamedTuple):
    """Ranked ``matches``, and one row on the ``pairs`` of a query and a block, those ``met`` and the ``candidates`` in them."""

    matches: DataFrame
    report: DataFrame


def _against_broadcast(
    queries: DataFrame, corpus: DataFrame, rows: int, k: int, least: float, skip_self: bool
) -> DataFrame:
    block = queries.select("id", "vector").toArrow().combine_chunks()
    if not len(block):
        return corpus.sparkSession.createDataFrame([], cells.MATCHES)
    shared = corpus.sparkSession.sparkContext.broadcast(
        (block.column("id").to_numpy(), cells.matrix(block.column("vector").combine_chunks()))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        for batch in batches:
            if len(batch):
                block = cells.as_block(batch.column("id").to_numpy(), cells.matrix(batch.column("vector")), k)
                for part in cells.best(query_ids, vectors, [block], k, least, skip_self):
                    yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    corpus = corpus.select("id", "vector")
    tasks = min(cells.MOST_SIDES**2, ceil(len(block) * rows / cells.PAIRS))
    # a small file of vectors is one partition, but many pairs
    return (corpus.repartition(tasks, "id") if tasks > 1 else corpus).mapInArrow(scan, cells.MATCHES)


def _tidy(vectors: DataFrame) -> DataFrame:
    vector = F.col("vector").cast("array<double>").alias("vector")
    return vectors.select(F.col("id").cast("bigint").alias("id"), vector).where("id is not null and size(vector) > 0")


def _check(k: int, min_similarity: float) -> None:
    if not 0 <= min_similarity <= 1:
        raise ValueError("min_similarity must be between 0 and 1")
    if k <= 0:
        raise ValueError("k must be positive")


def _one_width(*sizes) -> None:
    found = {n for r in sizes for n in (r["least"], r["most"]) if n is not None}
    if len(found) > 1:
        raise ValueError(f"vectors of {min(found)} to {max(found)} components cannot be compared")


def _measured(vectors: DataFrame):
    lengths = [F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")]
    return vectors.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("cells"), *lengths).first()


def _ranked(matches: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    ranked = matches.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "similarity")


def similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = cells.BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` corpus vectors most like each query vector.

    Both sides have ``id`` and ``vector``, all vectors of one length. Gives
    ``query_id``, ``rank`` from 1, ``id`` and ``similarity``, which is at least
    ``min_similarity``; equal similarities are ordered by id. ``skip_self``
    leaves out the vector with the query's own id. A NULL or empty vector, or
    one of norm zero, is like no other; vectors of several lengths are an error.
    A row without an id takes no part.
    """
    _check(k, min_similarity)
    queries, corpus = _tidy(queries), _tidy(corpus)
    size, held = _measured(queries), _measured(corpus)
    _one_width(size, held)
    if 8 * (size["cells"] or 0) + ROW_BYTES * size["n"] <= broadcast_bytes:
        return _ranked(_against_broadcast(queries, corpus, held["n"], k, min_similarity, skip_self), k)
    layout = cells.lay_out(corpus, held["n"], block_rows=block_rows)
    return _ranked(cells.exact(queries, layout, k, min_similarity, skip_self)[0], k)


def similar_by_blocks(
    queries: DataFrame, layout: cells.Layout, k: int = TOP_K, min_similarity: float = MIN_SIMILARITY, skip_self: bool = False
) -> Found:
    """The same as :func:`similar` over a corpus laid out by :func:`lay_out`, and what its bounds skipped."""
    _check(k, min_similarity)
    queries = _tidy(queries)
    _one_width(_measured(queries), _width_of(layout))
    matches, report = cells.exact(queries, layout, k, min_similarity, skip_self)
    return Found(_ranked(matches, k), report)


def similar_in_cells(
    queries: DataFrame,
    layout: cells.Layout,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    skip_self: bool = False,
    probes: int | None = None,
    recall: float = RECALL,
) -> Found:
    """As :func:`similar`, among the vectors in the ``probes`` cells nearest to each query.

    Without ``probes``, their number is what holds the share ``recall`` of
    the true neighbours within a bounded sample of the corpus. A match may be
    missing; one that is given out has its true similarity.
    """
    _check(k, min_similarity)
    queries = _tidy(queries)
    _one_width(_measured(queries), _width_of(layout))
    if probes is None:
        sample = cells.draw_sample(layout.blocks.select(F.col("vid").alias("id"), F.col("unit").alias("vector")))
        probes = cells.choose_probes(sample, layout.centroids, k, recall)
    matches, report = cells.near(queries, layout, k, min_similarity, skip_self, probes)
    return Found(_ranked(matches, k), report)


def lay_out(corpus: DataFrame, n_cells: int | None = None, block_rows: int = cells.BLOCK_ROWS) -> cells.Layout:
    """Cells and blocks of a corpus of ``id`` and ``vector``; every vector with a direction is in them."""
    corpus = _tidy(corpus)
    size = _measured(corpus)
    _one_width(size)
    return cells.lay_out(corpus, size["n"], n_cells, block_rows)


def _width_of(layout: cells.Layout) -> dict:
    width = layout.centroids.shape[1] or None
    return {"least": width, "most": width}


def retrieved_ids(matches: DataFrame) -> DataFrame:
    """The matches of each query as the list a query row stores, best first."""
    best_first = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return matches.groupBy("query_id").agg(
        F.transform(best_first, lambda m: m["id"]).alias("retrieved_ids")
    )
