"""Exact top-k by integer inner product, with MaxScore pruning in shards.

Every dimension is a term, and a shard keeps its postings by dimension with
the largest and smallest component. For a query these bound what a term can
add to a score. Terms whose bounds together cannot lift a vector over the
k-th best score so far are non-essential: the essential postings are
traversed for all vectors of the shard, and the others are probed, the
strongest first, for the vectors that can still compete. The best k of each
shard are merged.

Queries and vectors meet in blocks of fixed size; a task holds one shard and
one block of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import buckets_for
from bibliospark.sources.durable import keep

SCALE = 256
SHARD_ROWS = 16_384
QUERY_ROWS = 1_024
#: Vectors scored in full to find a first threshold.
FIRST_ROWS = 512
#: Non-essential terms probed before the competing vectors are pruned again.
PROBED = 8
#: Components and scores are longs; bounds are summed in longs only while they stay below half of that.
LONG = 1 << 63


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``terms``: floor(scale * x) of each component as a double.

    Vectors that are null or hold a null or non-finite component, and rows
    without an id, are left out. A component that is no long once scaled is an
    error.
    """
    doubles = F.col(vector_col).cast("array<double>")
    finite = F.forall(doubles, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall(doubles, lambda v: F.abs(v * scale) < float(LONG))
    terms = F.transform(doubles, lambda v: F.floor(v * scale)).cast("array<long>")
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"),
        F.when(fits, terms).otherwise(F.raise_error(F.lit("a scaled component is no long"))).alias("terms"),
    )


def _packed(rows: DataFrame, number: Column, width: int, kind: str) -> DataFrame:
    """One row per block: its ids and its terms as a matrix of longs, sorted by id."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        terms = table.column("terms").combine_chunks()
        matrix = np.zeros((len(table), width), dtype=np.int64)
        lengths = terms.value_lengths().to_numpy()
        places = np.arange(width) < lengths[:, None]  # a shorter vector ends in zeros
        matrix[places] = terms.flatten().to_numpy()
        return pa.table(
            {
                kind: pa.array([table.column("number")[0].as_py()], pa.int32()),
                "ids": [table.column("id").to_numpy().tobytes()],
                "matrix": pa.array([matrix.tobytes()], pa.binary()),
            }
        )

    numbered = rows.withColumn("number", number)
    return numbered.groupBy("number").applyInArrow(pack, f"{kind} int, ids binary, matrix binary")


class Shard:
    """Postings by dimension with their largest and smallest components."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids = ids
        self.postings = matrix.T  # not copied: only components too large for doubles are read from it
        # doubles are exact as long as every partial sum fits their mantissa
        self.doubles = np.ascontiguousarray(self.postings, dtype=np.float64)
        self.largest = matrix.max(axis=0) if len(matrix) else np.zeros(matrix.shape[1], np.int64)
        self.smallest = matrix.min(axis=0) if len(matrix) else np.zeros(matrix.shape[1], np.int64)
        self.peak = int(np.abs(matrix).max(initial=0))

    def best(self, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, best first, ties to the smaller id, ``own_id`` left out.

        Where the bounds could leave long, every vector is scored instead; a
        score that leaves long, to within the rounding of doubles, is an error.
        """
        furthest = self.peak * int(np.abs(query).max(initial=0)) * max(1, len(query))
        exact = furthest < 1 << 53
        postings = self.doubles if exact else self.postings
        q = query.astype(postings.dtype)
        others = np.flatnonzero(self.ids != own_id)
        if furthest >= LONG >> 1:
            near = np.abs(query.astype(np.float64) @ self.doubles[:, others])
            if near.max(initial=0) + furthest / (1 << 50) >= LONG:
                raise ValueError(f"a score of vector {own_id} is no long")
            return self.best(self.ids[others], (q @ postings)[others], k)  # sums that wrap on the way end right
        first = others[:FIRST_ROWS]
        scores = (q @ postings[:, first]).astype(np.int64)
        ids, scores = self.best(self.ids[first], scores, k)
        rest = others[FIRST_ROWS:]
        if not len(rest):
            return ids, scores
        threshold = scores[-1] if len(scores) == k else np.iinfo(np.int64).min
        ends = np.stack([query * self.largest, query * self.smallest])
        upper, lower = ends.max(axis=0), ends.min(axis=0)
        order = np.argsort(-(upper - lower), kind="stable")
        # how far the terms from here on can lift a score above the least it can be
        lift = np.cumsum((upper - lower)[order][::-1])[::-1]
        spare = int(threshold) - int(lower.sum()) if len(scores) == k else -1
        essential = int(np.count_nonzero(lift > spare))
        ahead = np.concatenate([np.cumsum(upper[order][::-1])[::-1], [0]])
        terms = order[:essential]
        # most queries need all terms, which are read in place
        scored = q @ postings if essential == len(order) else q[terms] @ postings[terms]
        partial = scored[rest].astype(np.int64)
        competing = partial + ahead[essential] >= threshold
        rest, partial = rest[competing], partial[competing]
        for at in range(essential, len(order), PROBED):
            if not len(rest):
                break
            terms = order[at : at + PROBED]
            partial = partial + (q[terms] @ postings[np.ix_(terms, rest)]).astype(np.int64)
            competing = partial + ahead[min(at + PROBED, len(order))] >= threshold
            rest, partial = rest[competing], partial[competing]
        return self.best(np.concatenate([ids, self.ids[rest]]), np.concatenate([scores, partial]), k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each query row its ``k`` best other rows.

    ``is_query`` tells, from the column ``id``, which rows are queries. Ties go
    to the smaller id; a query with fewer than ``k`` candidates gets all of
    them. Rows with the query's own id are not its candidates. Vectors that
    are null or hold null or non-finite components, and rows without an id,
    take no part; a shorter vector counts as ending in zeros. Repeated rows
    are candidates each, and a repeated query row is answered each time.
    Extra columns are ignored; an empty table gives no rows. Large components
    are scored exactly in longs; a component or score that is no long is an error.
    """
    rows = keep(quantized(vectors, id_col, vector_col, scale), "vectors")
    size = rows.agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("queries"), F.max(F.size("terms")).alias("width")
    ).first()
    shards, blocks, width = buckets_for(size.n, SHARD_ROWS), buckets_for(size.queries, QUERY_ROWS), size.width or 0
    shard_of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    held = _packed(rows, shard_of, width, "shard")
    asked = _packed(rows.where(is_query), block_of, width, "block")
    # every shard goes to every block of queries, as blocks, never as pairs of rows
    met = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
    met = met.unionByName(
        asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for asks, ids, matrix in zip(pdf["asks"], pdf["ids"], pdf["matrix"]):
            own = np.frombuffer(ids, dtype=np.int64)
            parts[bool(asks)] = own, np.frombuffer(matrix, dtype=np.int64).reshape(len(own), width)
        out = {c: [] for c in ("place", "query_id", "vec_id", "score")}
        if len(parts) == 2:
            shard = Shard(*parts[False])
            for place, (query_id, query) in enumerate(zip(*parts[True])):
                ids, scores = shard.search(query_id, query, k)
                out["place"] += [place] * len(ids)
                out["query_id"] += [int(query_id)] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).assign(block=int(pdf["block"].iloc[0]))[["block", *out]].astype("int64")

    found = met.groupBy("shard", "block").applyInPandas(
        search, "block long, place long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return (
        keep(found, "shard-matches")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
