"""A training mix: words per source by weight, and a position in training for each document.

Weights give each source a target of words. A source's words are laid out in a
hashed order, epoch after epoch, until its target is met by whole documents.
Each source also has a weight schedule over training time; integrated, it says
what share of the source's target is wanted by time t. Inverting that demand
at the place of a document gives its position, and the mix is range-sorted by
position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import WORD, buckets_for, fresh, number_within
from bibliospark.operators.ids import assign_ids
from bibliospark.sources.durable import keep

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Weight over training time per source, repeated likewise: knots (time, height), linear between them.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)),
)
#: One row per source is planned on the driver; more sources than this are an error.
MAX_SOURCES = 1_000_000


@dataclass
class Share:
    """A source's plan: every document ``base`` times, and documents of ``extra`` words once more."""

    source: str | None
    source_size: int
    target: float
    base: int
    extra: int
    schedule: int


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """``total`` shared by weight, no share above ``cap`` times its size."""
    left, out = total, [0.0] * len(sizes)
    active = [i for i, s in enumerate(sizes) if s > 0]
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in active:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        active = [i for i in active if i not in set(full)]
    return out


def plan_shares(sources: list[Row], share: float, cap: int, weights=WEIGHTS, n_schedules: int = len(SCHEDULES)) -> list[Share]:
    """The plan of every source; ``sources`` has ``source`` and ``source_size``."""
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"{len(sources)} sources; the plan is made for at most {MAX_SOURCES}")
    ordered = sorted(sources, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in ordered]
    heights = [weights[i % len(weights)] for i in range(len(ordered))]
    wanted = targets(sizes, heights, share * sum(sizes), cap)
    plan = []
    for i, (row, size, target) in enumerate(zip(ordered, sizes, wanted)):
        base = min(cap, floor(target / size)) if size else 0
        extra = 0 if base == cap else round(target - base * size)
        plan.append(Share(row.source, size, target, base, extra, i % n_schedules))
    return plan


def invert_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the integral of the schedule reaches ``share`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, None
    for (t0, h0), (t1, h1), area in zip(knots, knots[1:], areas):
        rest = share * whole - F.lit(done)
        slope = (h1 - h0) / (t1 - t0)
        if slope:
            inside = (F.sqrt(F.greatest(F.lit(h0 * h0) + 2 * slope * rest, F.lit(0.0))) - h0) / slope
        else:
            inside = rest / h0
        done += area
        here = F.least(F.lit(t0) + inside, F.lit(t1))
        out = here if out is None else F.when(share * whole <= F.lit(done - area), out).otherwise(here)
    return out


def _time_of(knots: tuple[tuple[float, float], ...]) -> Callable[[Column], Column]:
    """From the first word of a copy, counted over all epochs of its source, to its time."""

    def time(start: Column) -> Column:
        target = F.col("target")
        return invert_demand(F.when(target > 0, F.least(start / target, F.lit(1.0))).otherwise(0.0), knots)

    return time


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``_order``, a hash of id and seed, and for ids of several rows of all that tells these apart.

    Rows alike in id, source, size and text are numbered, spread by ``_row``, so
    that very many rows of one id get as many hashes. Which of them has which
    number does not matter: the numbers are the same however rows are dealt.
    """
    several = rows.groupBy("_order").agg(F.count("*").alias("_n")).where("_n > 1").select("_order")
    # stored, so that the join with the rows of a heavy id can be split
    several = keep(several, "mix-several")
    again = rows.join(several, "_order", "left_semi").withColumn(
        "_alike", F.xxhash64("_order", "doc_id", "source", "size", "_text")
    )
    again = keep(again, "mix-repeated")
    numbered = number_within(again, "_alike", ["_row"], "_nth", again.count())
    own = F.xxhash64(F.lit(seed), F.col("_alike"), F.col("_nth"))
    once = rows.join(several, "_order", "left_anti")
    return once.unionByName(numbered.withColumn("_order", own).drop("_alike", "_nth")).drop("_row", "_text")


def _laid_out(rows: DataFrame) -> DataFrame:
    """Add ``_end``: the words of the source up to and including the document, in hashed order.

    A source's documents are cut by their hash into ranges of about 50,000
    rows, so a source with a third of all rows is summed by many tasks.
    """
    bits = max(0, (buckets_for(rows.count()) - 1).bit_length())
    bucket = F.shiftrightunsigned("_order", 64 - bits).cast("int") if bits else F.lit(0)
    cut = rows.withColumn("_cut", bucket)
    before = Window.partitionBy("_ix").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("_ix", "_cut")
        .agg(F.sum("size").alias("_n"))
        .select("_ix", "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    order = Window.partitionBy("_ix", "_cut").orderBy("_order", "doc_id", "size")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        cut.withColumn("_inside", inside)
        .join(starts, ["_ix", "_cut"])
        .withColumn("_end", F.col("_start") + F.col("_inside"))
        .drop("_cut", "_inside", "_start")
    )


def _fill(laid: DataFrame, plan: list[Share]) -> DataFrame:
    """Documents beyond the prefix that close each source's gap: (``_ix``, ``_end``, ``_place``).

    Each round lays out the documents left that fit a source's gap, in hashed
    order, and takes the prefix that fits together, until none fits. A document
    is named by its ``_end``, which is unique among the documents of a source
    that have words.
    """
    spark = laid.sparkSession
    inside = laid.where((F.col("_end") <= F.col("_extra")) & (F.col("size") > 0))
    reached = {r._ix: r.n for r in inside.groupBy("_ix").agg(F.sum("size").alias("n")).collect()}
    gaps = {i: p.extra - reached.get(i, 0) for i, p in enumerate(plan)}
    picked = spark.createDataFrame([], "_ix int, _end long, _place long")
    left = laid.where(F.col("_end") > F.col("_extra")).select("_ix", "doc_id", "size", "_order", F.col("_end").alias("_first_end"))
    while open_gaps := [(i, g, plan[i].extra - g) for i, g in gaps.items() if g > 0]:
        table = spark.createDataFrame(open_gaps, "_ix int, _gap long, _reached long")
        fits = left.join(F.broadcast(table), "_ix").where(F.col("size").between(1, F.col("_gap")))
        again = keep(_laid_out(keep(fits, "mix-fits")), "mix-laid-again")
        taken = again.where(F.col("_end") <= F.col("_gap"))
        sums = taken.groupBy("_ix").agg(F.sum("size").alias("n")).collect()
        if not sums:
            break
        for r in sums:
            gaps[r._ix] -= r.n
        picked = picked.unionByName(
            taken.select(
                "_ix", F.col("_first_end").alias("_end"), (F.col("_reached") + F.col("_end") - F.col("size")).alias("_place")
            )
        )
        left = again.where(F.col("_end") > F.col("_gap")).drop("_gap", "_reached", "_end")
    return picked


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: int = 2,
    seed: int = 7,
    keep_cols: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: how many times the mix takes it, and where.

    Columns: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``copies``, ``taken`` and ``positions`` (array of times in [0, 1), one per
    copy), plus ``keep_cols``. A null text has size 0, is kept and taken as
    often as its source is taken whole. A null source is a source of its own,
    ordered last. Repeated rows count each. An empty table gives no rows.
    Every taken document is whole, so a source misses its target by less than
    its smallest document that is left. Reruns give the same mix: the order
    is a hash of the id and the seed, and where an id has several rows also of
    their sources, sizes, texts and numbers.

    One row per source goes through the driver, where weights are given; the
    documents stay distributed.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_order"),
        F.xxhash64(text_col).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
        *keep_cols,
    )
    rows = _ordered(keep(rows, "mix-rows"), seed)
    spark = docs.sparkSession
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    plan = plan_shares(sums, share, cap)
    shares = spark.createDataFrame(
        [(i, p.source, p.source_size, p.target, p.base, p.extra, p.schedule) for i, p in enumerate(plan)],
        "_ix int, _source string, source_size long, target double, _base int, _extra long, _schedule int",
    )
    joined = rows.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = keep(_laid_out(joined), "mix-laid")
    marked = laid.join(_fill(laid, plan).withColumn("_some", F.lit(True)), ["_ix", "_end"], "left")
    in_prefix = (F.col("_end") <= F.col("_extra")) & (F.col("_extra") > 0)
    filled = F.col("_some").isNotNull() & (F.col("size") > 0)
    more = F.when(in_prefix | filled, 1).otherwise(0)
    place = F.when(in_prefix, F.col("_end") - F.col("size")).otherwise(F.col("_place"))
    start = F.col("_end") - F.col("size")
    starts = F.array_compact(
        F.concat(
            F.transform(
                F.when(F.col("_base") > 0, F.sequence(F.lit(0), F.col("_base") - 1)).otherwise(F.array().cast("array<int>")),
                lambda e: e * F.col("source_size") + start,
            ),
            F.array(F.when(more == 1, F.col("_base") * F.col("source_size") + place)),
        )
    )
    times = F.lit(None).cast("array<double>")
    for i, knots in enumerate(SCHEDULES):
        times = F.when(F.col("_schedule") == i, F.transform(starts, _time_of(knots))).otherwise(times)
    copies = (F.col("_base") + more).cast("int")
    return marked.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        times.alias("positions"),
        *keep_cols,
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy with its ``position`` and ``place``, its number in training order from 0, without gaps.

    Copies are sorted over range partitions by position, then source, id and
    what else a row holds, and numbered there; only partitions' sizes meet in one place.
    """
    copies = mixed.withColumn("position", F.explode("positions")).drop("positions")
    rest = [c for c in copies.columns if c not in ("position", "source", "doc_id")]
    placed = assign_ids(copies, ["position", "source", "doc_id", *rest], -1)
    return placed.withColumnRenamed("id", "place")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in training order; columns stay as they are.

    Rows are planned without their texts: only an id, a hash of the text and
    positions are sorted and summed. Texts are moved twice, to meet their
    positions and to be sorted by them. Of rows alike in id and text, one
    stands for all and comes as often as they together.
    """
    same, nth, position, order = (fresh(c, docs) for c in ("text_hash", "nth", "position", "mix_source"))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(how.get("source_col", "source")).alias("source"),
        F.xxhash64(text_col).alias("hash"),
    )
    planned = mix(narrow, keep_cols=("hash",), **{k: v for k, v in how.items() if k != "source_col"})
    # a null id is its own key: ids are joined as a value and whether there is one
    id_of, has_id = fresh("id_value", docs), fresh("has_id", docs)
    blank = F.lit(0).cast(docs.schema[id_col].dataType)
    places = (
        planned.where("copies > 0")
        .groupBy("doc_id", "hash")
        .agg(F.flatten(F.collect_list("positions")).alias(position), F.min("source").alias(order))
        .select(
            F.coalesce("doc_id", blank).alias(id_of), F.col("doc_id").isNotNull().alias(has_id),
            F.col("hash").alias(same), position, order,
        )
    )
    key = [id_of, has_id, same]
    wide = (
        docs.withColumn(id_of, F.coalesce(F.col(id_col), blank))
        .withColumn(has_id, F.col(id_col).isNotNull())
        .withColumn(same, F.xxhash64(text_col))
    )
    # numbered by the key of the join, so that both need one shuffle
    once = wide.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    copies = once.join(keep(places, "mix-places"), key).withColumn(position, F.explode(position))
    return copies.orderBy(position, order, id_of, same).select(*docs.columns)
