"""Ranked lexical search with range-maximum tables over posting lists.

Documents are dealt to shards, and a shard keeps for every query term its
posting list in document order: the share of the term's weight that each
document earns. A sparse table over the lists answers the largest share, and
the document that has it, within any interval of documents. The summed
answers of a query's terms bound every score in the interval. Search goes best first:
the intervals with the largest bounds are split at their document of maximum
impact, that document is scored, and the two intervals beside it get bounds
of their own; an interval of few documents is scored whole. It ends when no
open interval can reach the k best. The best of all shards are merged.

Shards are cut by their number of postings and queries by their number of
terms, so that a task holds one shard and one block of queries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import buckets_for
from bibliospark.sources.durable import keep

#: Terms: runs of ASCII letters, digits and any characters beyond ASCII, as bytes of UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text whose terms are counted at once.
PART = 1 << 20
#: Postings of a shard, and terms of a block of queries.
POSTINGS = 1 << 20
QUERY_TERMS = 1 << 18
#: Intervals of at most so many documents are scored whole.
LEAF = 24
#: Intervals split at once, at most, and interval-term cells worked on at once.
BATCH, CELLS = 256, 1 << 20

_COUNTED = "id {}, n long, terms array<string>, times array<long>"


def count_terms(raw: bytes) -> Counter:
    """How often each term occurs in a text, A-Z lower-cased; very long texts are counted part by part."""
    if len(raw) <= PART:
        return Counter(TERM.findall(raw.lower()))
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + PART)
        end = gap.start() if gap else len(raw)
        counts.update(TERM.findall(raw[at:end].lower()))
        at = end
    return counts


def _counted(texts: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """``row``, ``id``, the number of terms ``n`` and the distinct terms with their counts; stored."""
    id_type = texts.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, ends, terms, times = [], [0], [], []
            for text in batch.column("text"):
                counts = count_terms(text.as_py() or b"")
                totals.append(sum(counts.values()))
                terms += counts
                times += counts.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            columns = [
                batch.column("id"),
                pa.array(totals, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "times"])

    named = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = named.mapInArrow(count, _COUNTED.format(id_type))
    return keep(found.withColumn("row", F.monotonically_increasing_id()), label)


def _each_term(counted: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("terms", "times")).alias("pair")
    return counted.select("row", "id", "n", pairs).select(
        "row", "id", "n", F.col("pair.terms").alias("term"), F.col("pair.times").alias("times")
    )


class Postings:
    """The posting lists of a shard, one after the other, and a range-maximum table over them.

    ``lists`` names the list of each posting (0, 1, ...) and ``docs`` its
    document, sorted by both; ``shares`` are below 2 ** 20. An entry of the
    table holds a share and, below it, the document, smaller ones larger.
    """

    def __init__(self, n_docs: int, lists: np.ndarray, docs: np.ndarray, shares: np.ndarray):
        self.n_docs = n_docs
        self.lists = lists.astype(np.int64)
        self.keys = self.lists * n_docs + docs
        self.bits = max(1, int(n_docs).bit_length())
        level = (shares.astype(np.int64) << self.bits) | (n_docs - 1 - docs.astype(np.int64))
        longest = int(np.bincount(self.lists).max(initial=0)) if len(lists) else 0
        levels, step = [level], 1
        while 2 * step <= longest:
            level = np.maximum(level[:-step], level[step:])
            levels.append(level)
            step *= 2
        self.table = np.concatenate(levels)
        self.level_at = np.cumsum([0, *map(len, levels)])[:-1]

    def places(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each document and list the first posting from that document on."""
        return np.searchsorted(self.keys, lists[None, :] * self.n_docs + docs[:, None])

    def bounds(self, lists: np.ndarray, weights: np.ndarray, first: np.ndarray, end: np.ndarray):
        """For each interval of documents the bound on its scores and the document of maximum impact."""
        begin, stop = self.places(lists, first), self.places(lists, end)
        length = stop - begin
        some = length > 0
        level = np.frexp(np.maximum(length, 1))[1] - 1
        base = self.level_at[level]
        left = np.where(some, base + begin, 0)
        right = np.where(some, base + stop - (1 << level), 0)
        best = np.where(some, np.maximum(self.table[left], self.table[right]), 0)
        impacts = (best >> self.bits) * weights
        top = np.argmax(np.where(some, impacts, -1), axis=1)
        doc = self.n_docs - 1 - (best[np.arange(len(first)), top] & ((1 << self.bits) - 1))
        return impacts.sum(axis=1), doc

    def score(self, lists: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The scores of single documents."""
        at = np.minimum(self.places(lists, docs), len(self.keys) - 1)
        found = self.keys[at] == lists[None, :] * self.n_docs + docs[:, None]
        return (np.where(found, self.table[at] >> self.bits, 0) * weights).sum(axis=1)

    def search(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the ``k`` largest scores above 0, best first, ties to the smaller one.

        ``lists`` are a query's lists, each once, and ``weights`` their
        weights times how often the query has them.
        """
        docs = scores = np.empty(0, np.int64)
        if not len(lists) or not len(self.keys):
            return docs, scores
        at_once = max(1, min(BATCH, CELLS // len(lists)))
        first, end = np.zeros(1, np.int64), np.full(1, self.n_docs)
        bound, peak = self.bounds(lists, weights, first, end)
        batch = 1
        while len(first):
            # best first
            order = np.argsort(-bound, kind="stable")
            taken, rest = order[:batch], order[batch:]
            some_first, some_end, some_peak = first[taken], end[taken], peak[taken]
            leaf = some_end - some_first <= LEAF
            inner = ~leaf
            widths = some_end[leaf] - some_first[leaf]
            inside = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
            new = np.concatenate([np.repeat(some_first[leaf], widths) + inside, some_peak[inner]])
            found = [self.score(lists, weights, new[i : i + at_once]) for i in range(0, len(new), at_once)]
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, *found])
            best = np.lexsort((docs, -scores))[:k]
            best = best[scores[best] > 0]
            docs, scores = docs[best], scores[best]
            least, last = (scores[-1], docs[-1]) if len(docs) == k else (1, self.n_docs)
            child_first = np.concatenate([some_first[inner], some_peak[inner] + 1])
            child_end = np.concatenate([some_peak[inner], some_end[inner]])
            real = child_first < child_end
            child_first, child_end = child_first[real], child_end[real]
            made = [
                self.bounds(lists, weights, child_first[i : i + at_once], child_end[i : i + at_once])
                for i in range(0, len(child_first), at_once)
            ]
            first, end = np.concatenate([first[rest], child_first]), np.concatenate([end[rest], child_end])
            bound = np.concatenate([bound[rest], *(b for b, _ in made)])
            peak = np.concatenate([peak[rest], *(p for _, p in made)])
            alive = (bound > least) | ((bound == least) & (first < last))
            first, end, bound, peak = first[alive], end[alive], bound[alive], peak[alive]
            batch = min(2 * batch, at_once)
        return docs, scores


def _pack_shard(table: pa.Table) -> pa.Table:
    """One row per shard: its documents in the order of ties, its terms, and its posting lists."""
    frame = table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    rows = frame[["row", "id"]].drop_duplicates("row").sort_values(["id", "row"], na_position="last")
    number = pd.Series(np.arange(len(rows)), index=rows["row"].to_numpy("int64"))
    docs = number.reindex(frame["row"].to_numpy("int64")).to_numpy("int64")
    terms, lists = np.unique(frame["term"].to_numpy("int64"), return_inverse=True)
    order = np.lexsort((docs, lists))
    as_bytes = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
    return pa.table(
        {
            "shard": pa.array([int(frame["shard"].iloc[0])], pa.int32()),
            "rows": pa.array([as_bytes(rows["row"].to_numpy("int64"), "i8")], pa.binary()),
            "ids": pa.array([as_bytes(rows["id"].fillna(0).to_numpy("int64"), "i8")], pa.binary()),
            "no_id": pa.array([as_bytes(rows["id"].isna().to_numpy(bool), "?")], pa.binary()),
            "terms": pa.array([as_bytes(terms, "i8")], pa.binary()),
            "lists": pa.array([as_bytes(lists[order], "i4")], pa.binary()),
            "docs": pa.array([as_bytes(docs[order], "i4")], pa.binary()),
            "shares": pa.array([as_bytes(frame["share"].to_numpy("int64")[order], "i4")], pa.binary()),
        }
    )


_SHARD = "shard int, rows binary, ids binary, no_id binary, terms binary, lists binary, docs binary, shares binary"


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): for each row of ``items`` its ``k`` best documents.

    A term's weight falls with the logarithm of the documents that hold it, and
    the share of it that a document earns grows with the term's count and falls
    with the document's length. All documents with a score above 0 can be
    returned; ties go to the smaller id, a null id last. A null or empty text
    has no terms and is neither counted nor found. Repeated documents are found
    each, repeated items answered each, and a null item id is kept. Other
    columns are ignored. No documents or no items give no rows.
    """
    counted = _counted(docs, id_col, text_col, "document-terms")
    asked = _counted(items, item_col, item_text_col, "query-terms")
    total = counted.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    wanted = _each_term(asked)
    distinct = wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id())
    vocabulary = keep(distinct, "vocabulary")
    measure = F.expr(f"75L + ((25L * n * {total['docs']}L) div {max(1, total['terms'])}L)")
    share = F.expr("(1000000000L * times) div (1000L * times + 12L * m)")
    held = (
        _each_term(counted)
        .join(vocabulary, "term")
        .withColumn("m", measure)
        .select("row", F.col("id").cast("long").alias("id"), F.col("number").alias("term"), share.alias("share"))
    )
    postings = keep(held, "postings")
    shards = buckets_for(postings.count(), POSTINGS)
    seen = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total["docs"]) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = vocabulary.join(seen, vocabulary["number"] == seen["term"]).select(
        vocabulary["term"], "number", weight.cast("long").alias("weight")
    )
    queries = keep(
        wanted.join(keep(weights, "term-weights"), "term").select(
            "row", F.col("id").alias("item_id"), "number", (F.col("times") * F.col("weight")).alias("weight")
        ),
        "queries",
    )
    blocks = buckets_for(queries.count(), QUERY_TERMS)
    asks = (
        queries.groupBy("row", "item_id")
        .agg(F.collect_list("number").alias("terms"), F.collect_list("weight").alias("weights"))
        .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .agg(F.collect_list(F.struct("row", "terms", "weights")).alias("asks"))
    )
    packed = (
        postings.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(_pack_shard, _SHARD)
    )
    # a shard meets every block of queries, each as one row
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(None))
    met = met.unionByName(
        asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), allowMissingColumns=True
    )

    def search(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("row", "doc_row", "doc_id", "score")}
        shard, block = None, None
        for line in table.to_pylist():
            shard, block = (line, block) if line["asks"] is None else (shard, line)
        if shard and block:
            read = lambda name, kind: np.frombuffer(shard[name], kind)
            rows, ids, no_id, terms = read("rows", "i8"), read("ids", "i8"), read("no_id", "?"), read("terms", "i8")
            lists = Postings(len(rows), read("lists", "i4"), read("docs", "i4"), read("shares", "i4"))
            for ask in block["asks"]:
                wanted, own = np.array(ask["terms"], np.int64), np.array(ask["weights"], np.int64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                here = (terms[at] == wanted) & (own > 0)
                found, scores = lists.search(at[here], own[here], k)
                out["row"] += [ask["row"]] * len(found)
                out["doc_row"] += rows[found].tolist()
                out["doc_id"] += [None if none else i for i, none in zip(ids[found].tolist(), no_id[found].tolist())]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = keep(
        met.groupBy("shard", "block").applyInArrow(search, "row long, doc_row long, doc_id long, score long"), "shard-bests"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc_row")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("id").alias("item_id")), "row").select("item_id", "rank", "doc_id", "score")
