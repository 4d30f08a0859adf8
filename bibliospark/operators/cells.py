"""Vectors laid out in blocks by cell and angle, and searches that visit few blocks.

Centroids are fitted on a bounded sample. Every vector belongs to the cell of
its nearest centroid; the corpus is sorted by cell and by the angle to the
centroid and cut into blocks of equal size, so that a cell of very many copies
becomes many blocks and small cells share one. What a block holds of a cell
lies between two angles, and by the triangle inequality these bound the cosine
of any query with any vector of the block.

An approximate search visits the blocks of the cells nearest to a query. The
exact one first visits the block with the largest bound, whose k-th best match
becomes the query's threshold, and then every block whose bound reaches it.
Queries travel to blocks: neighbouring blocks stand on one shelf, a shelf is
held by a task while the queries stream past it, and each of them tells the
blocks on it that it visits. A shelf that many queries ask for is held by
several tasks. So a vector is shuffled once a shelf or a share of the queries,
not once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibliospark.operators.ids import assign_ids
from bibliospark.sources.durable import keep

#: Vectors on which centroids are fitted, and at most so many to a fitted cell.
SAMPLE_ROWS = 16_384
SAMPLE_PER_CELL = 16
FIT_STEPS = 10
#: Rows of a block; more if the corpus would have more than so many blocks, whose bounds every task holds.
BLOCK_ROWS = 50_000
MOST_BLOCKS = 1_000_000
#: Queries that one task takes past a shelf.
ASKS = 1_000_000
#: Bytes of the vectors on a shelf, more if one block is larger.
SHELF_BYTES = 64 * 1024 * 1024
#: Pairs of vectors worth a task of their own, while that makes no more shelves and no more shares of a shelf than this.
PAIRS = 250_000_000
MOST_SIDES = 8
#: Bounds of blocks and angles to cells that one task computes.
BOUNDS = 50_000_000
#: Similarities compared at once.
TILE_CELLS = 1_000_000
TILE_ROWS = 2_048
#: Pairs compared when probes are chosen.
SAMPLE_CELLS = 4_000_000
#: Room for rounding in a bound; angles are exact to about 2e-8.
ROUNDING = 1e-7
#: Products of equal vectors may differ in the last bits; rounded, they tie.
DIGITS = 12

MATCHES = "query_id bigint, id bigint, similarity double"


class Layout(NamedTuple):
    """``blocks`` (``vid``, ``unit``, ``cell``, ``angle``, ``block``), the centroids, and a block's angles by cell."""

    blocks: DataFrame
    centroids: np.ndarray
    segments: pd.DataFrame

    @property
    def n_blocks(self) -> int:
        return int(self.segments["block"].max()) + 1 if len(self.segments) else 0


def matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows of a list column of one length; a row without a direction is NaN."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Block(NamedTuple):
    """Vectors in the order of their ids, and the same in single precision."""

    ids: np.ndarray
    units: np.ndarray
    singles: np.ndarray


def as_block(ids: np.ndarray, units: np.ndarray, k: int) -> Block:
    """A block without the copies of a vector that no list of ``k`` can hold.

    Of equal vectors those with the ``k`` + 1 smallest ids stay, as one of them
    may be the query's own, and of rows that agree in id too, ``k``.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, units = ids[by_id], np.ascontiguousarray(units[by_id])
    if len(ids) > k + 1 and units.shape[1]:
        values, often = np.unique(units[:, 0], return_counts=True)
        some = np.flatnonzero(np.isin(units[:, 0], values[often > k]))
        if len(some):
            whole = units[some].view(np.dtype((np.void, units.shape[1] * units.itemsize))).ravel()
            group = np.unique(whole, return_inverse=True)[1].ravel()
            line = np.argsort(group, kind="stable")
            group, own = group[line], ids[some[line]]
            at = np.arange(len(line))
            new_group = np.diff(group, prepend=-1) != 0
            new_id = new_group | (np.diff(own, prepend=own[0]) != 0)
            nth_id = np.cumsum(new_id)
            nth_id -= np.maximum.accumulate(np.where(new_group, nth_id, 0))
            repeat = at - np.maximum.accumulate(np.where(new_id, at, 0))
            stays = np.ones(len(ids), bool)
            stays[some[line[(nth_id > k) | (repeat >= k)]]] = False
            ids, units = ids[stays], units[stays]
    return Block(ids, units, units.astype(np.float32))


def best(
    query_ids: np.ndarray,
    queries: np.ndarray,
    blocks: list[Block],
    k: int,
    least: float | np.ndarray,
    skip_self: bool,
    visits: np.ndarray | None = None,
) -> Iterator[pd.DataFrame]:
    """The k best matches of each query in the blocks it visits, some queries at a time.

    ``least`` is the smallest similarity, one for all or one a query; ``visits``
    tells for each query and block whether they meet, all of them without it. Of
    matches that tie at the k-th place those with the smallest ids are given
    out, so that many copies of a vector give no more than k rows.

    Products in single precision, with room for their error, tell the pairs
    that may be among the best; these are computed in double precision.
    """
    least = np.broadcast_to(np.asarray(least, float), len(query_ids))
    step = max(1, min(TILE_ROWS, TILE_CELLS // max(1, max((len(b.ids) for b in blocks), default=1))), 512)
    slack = (queries.shape[1] + 8) * 2.0**-23
    for at in range(0, len(query_ids), step):
        some, units = query_ids[at : at + step], queries[at : at + step]
        singles, floor = units.astype(np.float32), least[at : at + step].copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for number, block in enumerate(blocks):
            rows = np.arange(len(some)) if visits is None else np.flatnonzero(visits[at : at + step, number])
            if not len(rows):
                continue
            mine = singles if len(rows) == len(some) else singles[rows]
            width = max(1, TILE_CELLS // len(rows))
            for begin in range(0, len(block.ids), width):
                ids, corpus = block.ids[begin : begin + width], block.units[begin : begin + width]
                rough = mine @ block.singles[begin : begin + width].T
                enough = (floor[rows] - slack).astype(np.float32)[:, None]
                flat = np.flatnonzero(rough >= enough)
                if len(flat) * 16 > rough.size and len(ids) > k:
                    if skip_self:
                        rough[some[rows][:, None] == ids[None, :]] = -np.inf
                    kth = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k, None]
                    flat = np.flatnonzero(rough >= np.maximum(enough, kth - np.float32(2 * slack)))
                if not len(flat):
                    continue
                r, c = np.divmod(flat, len(ids))
                if len(flat) * 16 > rough.size:
                    similarity = (units[rows] @ corpus.T)[r, c]
                else:
                    similarity = np.einsum("ij,ij->i", units[rows[r]], corpus[c])
                similarity = np.round(similarity, DIGITS)
                good = similarity >= floor[rows[r]]
                if skip_self:
                    good &= some[rows[r]] != ids[c]
                found.append((rows[r[good]], ids[c[good]], similarity[good]))
                waiting += len(found[-1][0])
                if waiting > 2 * k * len(some):
                    found = [_foremost(found, k, floor)]
                    waiting = 0
        if found:
            q, ids, similarity = _foremost(found, k, floor)
            yield pd.DataFrame({"query_id": some[q], "id": ids, "similarity": similarity})


def _foremost(
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query so far; ``floor`` rises to the k-th."""
    q, ids, similarity = (np.concatenate(part) for part in zip(*found))
    line = np.lexsort((ids, -similarity, q))
    q, ids, similarity = q[line], ids[line], similarity[line]
    at = np.arange(len(q))
    rank = at - np.maximum.accumulate(np.where(np.diff(q, prepend=-1) != 0, at, 0))
    last = rank == k - 1
    floor[q[last]] = similarity[last]
    stays = rank < k
    return q[stays], ids[stays], similarity[stays]


def draw_sample(corpus: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``rows`` unit vectors, drawn by a hash of the id."""
    drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(rows).select("vector").toArrow()
    units = matrix(drawn.column("vector").combine_chunks()) if len(drawn) else np.empty((0, 0))
    return units[np.isfinite(units).all(axis=1)]


def fit_centroids(sample: np.ndarray, cells: int, steps: int = FIT_STEPS) -> np.ndarray:
    """Unit centroids by k-means on the sphere; the first ones are spread over the sample's distinct vectors."""
    distinct = np.unique(sample, axis=0)
    if not len(distinct):
        return sample[:0]
    start = np.random.default_rng(0).permutation(len(distinct))[: max(1, min(cells, len(distinct)))]
    centroids = distinct[start]
    for _ in range(steps):
        near = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def choose_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many nearest cells hold this share of the sample's true neighbours within the sample.

    In the whole corpus neighbours are nearer than in a sample, so the recall there is no lower as a rule.
    """
    asked = sample[: max(1, SAMPLE_CELLS // max(1, len(sample)))]
    if not len(asked):
        return 1
    found = asked @ sample.T
    found[np.arange(len(asked)), np.arange(len(asked))] = -2
    nearest = np.argsort(-found, axis=1, kind="stable")[:, :k]
    cell = np.argmax(sample @ centroids.T, axis=1)
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.take_along_axis(place, cell[nearest], axis=1)
    return int(np.quantile(needed, min(1.0, recall), method="higher")) + 1


def lay_out(
    corpus: DataFrame, rows: int, cells: int | None = None, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS
) -> Layout:
    """Lay out a corpus of ``id`` and ``vector``, of about ``rows`` rows; its copy is stored.

    Vectors without a direction are left out. The sample bounds the number of
    cells; every vector is laid out whatever the sample.
    """
    sample = draw_sample(corpus, sample_rows)
    wanted = ceil(sqrt(rows)) if cells is None else cells
    centroids = fit_centroids(sample, max(1, min(wanted, ceil(len(sample) / SAMPLE_PER_CELL))) if cells is None else wanted)
    if not len(centroids):
        centroids = np.zeros((1, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column("vector"))
            whole = np.isfinite(units).all(axis=1) if units.size else np.zeros(len(units), bool)
            units = units[whole]
            if not len(units):
                continue
            near = np.clip(units @ centroids.T, -1, 1)
            cell = near.argmax(axis=1)
            angle = np.arccos(near[np.arange(len(units)), cell])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(units) + 1) * units.shape[1], pa.int32()), pa.array(units.ravel())
            )
            kept = batch.column("id").filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays(
                [kept, lists, pa.array(cell.astype(np.int32)), pa.array(angle)], ["vid", "unit", "cell", "angle"]
            )

    placed = corpus.select("id", "vector").mapInArrow(place, "vid bigint, unit array<double>, cell int, angle double")
    numbered = assign_ids(placed, ["cell", "angle", "vid"], -1)
    size = max(block_rows, ceil(rows / MOST_BLOCKS))
    blocks = numbered.withColumn("block", F.expr(f"id div {size}").cast("int")).drop("id")
    return Layout(blocks, centroids, _segments(blocks))


def _segments(blocks: DataFrame) -> pd.DataFrame:
    """At most one row a block and one a cell more: they are pieces of one sorted line."""
    pieces = blocks.groupBy("block", "cell").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")
    )
    return pieces.toPandas().sort_values(["block", "cell"], ignore_index=True)


def save(layout: Layout, root: str) -> None:
    """Write a layout to a new place, to be searched again later."""
    spark = layout.blocks.sparkSession
    layout.blocks.write.mode("errorifexists").parquet(f"{root}/blocks")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(layout.centroids)]
    spark.createDataFrame(rows, "cell int, unit array<double>").write.mode("errorifexists").parquet(f"{root}/centroids")


def load(spark: SparkSession, root: str) -> Layout:
    centroids = spark.read.parquet(f"{root}/centroids").orderBy("cell").collect()
    blocks = spark.read.parquet(f"{root}/blocks")
    return Layout(blocks, np.array([r.unit for r in centroids]), _segments(blocks))


#: From angles to the centroids and a floor for each query: for each query and block whether they meet.
Visit = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _bounds(angles: np.ndarray, segments: pd.DataFrame) -> np.ndarray:
    """For each query and block the largest cosine that the block can hold."""
    theta = angles[:, segments["cell"].to_numpy()]
    gap = np.maximum(np.maximum(theta - segments["high"].to_numpy(), segments["low"].to_numpy() - theta), 0)
    firsts = np.flatnonzero(np.diff(segments["block"].to_numpy(), prepend=-1))
    return np.maximum.reduceat(np.cos(gap), firsts, axis=1) + ROUNDING


def _visit_first(layout_segments: pd.DataFrame) -> Visit:
    def visit(angles: np.ndarray, floors: np.ndarray) -> np.ndarray:
        bounds = _bounds(angles, layout_segments)
        reach, rows, top = np.zeros(bounds.shape, bool), np.arange(len(bounds)), bounds.argmax(axis=1)
        reach[rows, top] = bounds[rows, top] >= floors
        return reach

    return visit


def _visit_rest(layout_segments: pd.DataFrame) -> Visit:
    def visit(angles: np.ndarray, floors: np.ndarray) -> np.ndarray:
        bounds = _bounds(angles, layout_segments)
        reach = bounds >= floors[:, None]
        reach[np.arange(len(bounds)), bounds.argmax(axis=1)] = False
        return reach

    return visit


def _visit_near(segments: pd.DataFrame, probes: int) -> Visit:
    cells = segments["cell"].to_numpy()
    firsts = np.flatnonzero(np.diff(segments["block"].to_numpy(), prepend=-1))

    def visit(angles: np.ndarray, floors: np.ndarray) -> np.ndarray:
        nearest = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        near = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(near, nearest, True, axis=1)
        return np.logical_or.reduceat(near[:, cells], firsts, axis=1)

    return visit


def _per_shelf(layout: Layout) -> int:
    """How many blocks stand on a shelf."""
    if not layout.n_blocks:
        return 1
    sizes = layout.segments.groupby("block")["n"].sum()
    rows, largest = int(sizes.sum()), int(sizes.max())
    sides = min(MOST_SIDES, ceil(rows / sqrt(PAIRS)))
    held = min(ceil(rows / sides), SHELF_BYTES // (8 * max(1, layout.centroids.shape[1])))
    return max(1, held // largest)


def _planned(queries: DataFrame, layout: Layout, visit: Visit, label: str) -> DataFrame:
    """``query_id``, ``unit``, ``floor``, the shelves each query visits with its blocks there as bits, and their numbers; stored."""
    nothing, per = layout.n_blocks == 0, _per_shelf(layout)
    centroids, per_tile = layout.centroids, max(1, SAMPLE_CELLS // max(1, len(layout.segments), len(layout.centroids)))
    sizes = layout.segments.groupby("block")["n"].sum().sort_index().to_numpy(np.int64)
    firsts = np.arange(0, layout.n_blocks, per)

    def shelves(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """How many shelves each query visits, their numbers, and the blocks on them."""
        asked = np.logical_or.reduceat(reach, firsts, axis=1)
        q, shelf = np.nonzero(asked)
        padded = np.pad(reach, ((0, 0), (0, len(firsts) * per - reach.shape[1]))).reshape(len(reach), len(firsts), per)
        return asked.sum(axis=1), shelf, [bits.tobytes() for bits in np.packbits(padded[q, shelf], axis=1)]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column("vector"))
            whole = np.isfinite(units).all(axis=1) if units.size else np.zeros(len(units), bool)
            units, floors, ids = units[whole], batch.column("floor").to_numpy()[whole], batch.column("id").filter(pa.array(whole))
            for at in range(0, len(units), per_tile):
                some = units[at : at + per_tile]
                reach = np.zeros((len(some), 0), bool)
                counts, shelf, bits = np.zeros(len(some), int), [], []
                if not nothing:
                    reach = visit(np.arccos(np.clip(some @ centroids.T, -1, 1)), floors[at : at + per_tile])
                    counts, shelf, bits = shelves(reach)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                kinds = [pa.array(shelf, pa.int32()), pa.array(bits, pa.binary())]
                columns = [
                    ids[at : at + per_tile],
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), pa.array(some.ravel())),
                    pa.array(floors[at : at + per_tile]),
                    pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(kinds, ["shelf", "blocks"])),
                    pa.array(reach.sum(axis=1), pa.int64()),
                    pa.array(reach @ sizes, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "unit", "floor", "asks", "met", "candidates"])

    schema = (
        "query_id bigint, unit array<double>, floor double, asks array<struct<shelf:int,blocks:binary>>, "
        "met bigint, candidates bigint"
    )
    dealt = queries.select("id", "vector", "floor")
    # a small file of queries is one partition, but many bounds
    parts = ceil(dealt.count() * (len(layout.segments) + len(layout.centroids)) / BOUNDS)
    return keep((dealt.repartition(parts, "id") if parts > 1 else dealt).mapInArrow(plan, schema), label)


def _meet(layout: Layout, planned: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Take every query past the blocks it visits; at most ``k`` matches of each and a shelf at its floor or above."""
    spark, per = planned.sparkSession, _per_shelf(layout)
    rows = layout.segments.groupby(layout.segments["block"] // per)["n"].sum()
    asks = planned.select("query_id", "unit", "floor", F.inline("asks"))
    # one row a shelf; shelves that nobody visits stay where they are
    tasks, many = [], 0
    for shelf, n in asks.groupBy("shelf").agg(F.count("*").alias("n")).orderBy("shelf").collect():
        shares = max(ceil(n / ASKS), min(MOST_SIDES, ceil(n * int(rows[shelf]) / PAIRS)))
        tasks.append((shelf, many, shares))
        many += shares
    if not tasks:
        return spark.createDataFrame([], MATCHES)
    tasks = F.broadcast(spark.createDataFrame(tasks, "shelf int, first int, shares int"))
    held = (
        layout.blocks.withColumn("shelf", F.expr(f"block div {per}").cast("int"))
        .join(tasks, "shelf")
        .withColumn("task", F.explode(F.sequence("first", F.col("first") + F.col("shares") - 1)))
        .select(
            "task", (F.col("block") - F.col("shelf") * per).alias("place"), F.col("vid").alias("id"), "unit",
            F.lit(0.0).alias("floor"), F.lit(None).cast("binary").alias("blocks"),
        )
    )
    sent = asks.join(tasks, "shelf").select(
        (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("shares"))).cast("int").alias("task"),
        F.lit(per).alias("place"), F.col("query_id").alias("id"), "unit", "floor", "blocks",
    )
    # the queries of a task come after the blocks of its shelf
    streamed = held.unionByName(sent).repartitionById(many, F.col("task")).sortWithinPartitions("task", "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, units, shelf, full = None, [], [], [], []

        def close() -> None:
            """The vectors of one block are there."""
            if ids:
                shelf.append(as_block(np.concatenate(ids), np.concatenate(units), k))
                ids.clear()
                units.clear()

        for batch in batches:
            if not len(batch):
                continue
            task, place = (batch.column(c).to_numpy() for c in ("task", "place"))
            numbers, floors, bits = batch.column("id").to_numpy(), batch.column("floor").to_numpy(), batch.column("blocks")
            vectors = batch.column("unit").flatten().to_numpy().reshape(len(batch), -1)
            starts = [0, *(np.flatnonzero((np.diff(task) != 0) | (np.diff(place) != 0)) + 1).tolist()]
            for begin, end in zip(starts, [*starts[1:], len(batch)]):
                now = (task[begin], place[begin])
                if now != at:
                    close()
                    if at is None or at[0] != now[0]:
                        shelf, full = [], []
                    at = now
                if now[1] < per:
                    if not ids:
                        full.append(now[1])
                    ids.append(numbers[begin:end])
                    units.append(vectors[begin:end])
                    continue
                told = np.frombuffer(b"".join(bits[begin:end].to_pylist()), np.uint8).reshape(end - begin, -1)
                visits = np.unpackbits(told, axis=1, count=per)[:, full].astype(bool)
                for part in best(numbers[begin:end], vectors[begin:end], shelf, k, floors[begin:end], skip_self, visits):
                    yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return streamed.mapInArrow(search, MATCHES)


def _report(layout: Layout, planned: list[DataFrame]) -> DataFrame:
    """One row: the pairs of a query and a block, those that met, and the vectors these compared."""
    met = planned[0].select("met", "candidates")
    for part in planned[1:]:
        met = met.unionByName(part.select("met", "candidates"))
    totals = met.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "candidates")))
    return planned[0].agg((F.count("*") * layout.n_blocks).alias("pairs")).join(totals).select("pairs", "met", "candidates")


def exact(
    queries: DataFrame, layout: Layout, k: int, least: float, skip_self: bool
) -> tuple[DataFrame, DataFrame]:
    """All of each query's ``k`` best matches of at least ``least``, some others, and a report on the pairs that met."""
    asked = queries.withColumn("floor", F.lit(float(least)))
    first = _planned(asked, layout, _visit_first(layout.segments), "first-visits")
    nearest = keep(_meet(layout, first, k, skip_self), "first-matches")
    by_similarity = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    kth = (
        nearest.withColumn("rank", F.row_number().over(by_similarity))
        .where(F.col("rank") == k)
        .select(F.col("query_id").alias("id"), F.col("similarity").alias("kth"))
    )
    raised = asked.join(kth, "id", "left").withColumn("floor", F.greatest("floor", "kth"))
    rest = _planned(raised, layout, _visit_rest(layout.segments), "other-visits")
    return nearest.unionByName(_meet(layout, rest, k, skip_self)), _report(layout, [first, rest])


def near(
    queries: DataFrame, layout: Layout, k: int, least: float, skip_self: bool, probes: int
) -> tuple[DataFrame, DataFrame]:
    """Matches in the blocks of each query's ``probes`` nearest cells, and a report on the pairs that met."""
    asked = queries.withColumn("floor", F.lit(float(least)))
    planned = _planned(asked, layout, _visit_near(layout.segments, probes), "near-visits")
    return _meet(layout, planned, k, skip_self), _report(layout, [planned])
