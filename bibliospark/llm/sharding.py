"""Shards of nearly equal bytes that keep groups whole, by Karmarkar-Karp differencing.

A group (all rows with one text) is never split. Differencing keeps a heap of
partial partitions into ``n_shards`` parts, at first one per group, and keeps
combining the two with the largest spread: the heaviest part of one with the
lightest of the other. It runs in levels, so that no task sees all groups:
each task differences about ``groups_per_task`` groups, and what is left of
each task, one partial partition with a small spread, is differenced again with
those of other tasks, until one is left.

Partitions that are even by themselves could no longer make up for a group
larger than a task's share. So the largest groups, at most as many as a task
takes, are differenced first, and as many others as level them are differenced
against what these leave. The driver gets ``n_shards`` sums in all.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import buckets_for, number_within
from bibliospark.sources.durable import keep

#: Bytes that storing a row takes besides its text.
ROW_BYTES = 8


def difference(partials: list[list[int]], n_parts: int) -> list[list[int]]:
    """For each partial partition the final part of each of its own parts.

    ``partials[i]`` holds at most ``n_parts`` byte sums. A merged part is a
    linked list of (partial, part) pairs, so combining costs no copying.
    """
    width = max((len(p) for p in partials), default=1)
    after: dict[int, int] = {}
    heap = []
    for i, sums in enumerate(partials):
        parts = [(s, i * width + j, i * width + j) for j, s in enumerate(sums)]
        parts += [(0, -1, -1)] * (n_parts - len(parts))
        parts.sort(reverse=True)
        heap.append((parts[-1][0] - parts[0][0], i, parts))
    heapq.heapify(heap)
    fresh = len(partials)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        parts = []
        for (a, head_a, tail_a), (b, head_b, tail_b) in zip(one, reversed(other)):
            if head_a < 0:
                head_a, tail_a = head_b, tail_b
            elif head_b >= 0:
                after[tail_a] = head_b
                tail_a = tail_b
            parts.append((a + b, head_a, tail_a))
        parts.sort(reverse=True)
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], fresh, parts))
        fresh += 1
    placed = [[0] * len(p) for p in partials]
    for part, (_, node, _) in enumerate(heap[0][2] if heap else []):
        while node >= 0:
            placed[node // width][node % width] = part
            node = after.get(node, -1)
    return placed


def levelled(loads: list[int], more: int) -> list[int]:
    """What of ``more`` each load gets so that the least ones end at one level."""
    order = sorted(range(len(loads)), key=loads.__getitem__)
    below, level = 0, 0
    for n, at in enumerate(order, 1):
        below += loads[at]
        level = (below + more) // n
        if n == len(order) or level <= loads[order[n]]:
            break
    return [max(0, level - load) for load in loads]


def assign_groups(groups: DataFrame, n_shards: int, groups_per_task: int, partials_per_task: int) -> DataFrame:
    """``groups`` (group, bytes; stored) with their ``shard``.

    The first level gives each group a part of its unit, a task's share of the
    groups; each further one gives the parts of up to ``partials_per_task``
    units parts of the unit above. Only one sum per unit and part goes up.
    Unit 0 has the groups above ``1 / groups_per_task`` of all bytes and those
    that level them, in units below 0 at first, whose parts keep their numbers.
    """
    size = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    units = buckets_for(size.n, groups_per_task)
    schema = "group string, bytes long, unit long, part int"

    def apart(pdf: pd.DataFrame, fixed: list[int] | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("group", ignore_index=True)
        partials = [[b] for b in pdf["bytes"].tolist()]
        placed = difference([*partials, fixed] if fixed else partials, n_shards)
        number = {part: j for j, part in enumerate(placed.pop())} if fixed else {p: p for p in range(n_shards)}
        return pdf.assign(part=[number[p[0]] for p in placed])[["group", "bytes", "unit", "part"]]

    if units == 1:
        alone = groups.withColumn("unit", F.lit(0).cast("long")).groupBy("unit").applyInPandas(lambda pdf: apart(pdf), schema)
        return keep(alone, "partial-shards").select("group", F.col("part").alias("shard"))

    large = F.col("bytes") > F.lit(size.bytes / groups_per_task)
    first = groups.where(large).withColumn("unit", F.lit(0).cast("long")).groupBy("unit")
    first = keep(first.applyInPandas(lambda pdf: apart(pdf), schema), "large-groups")
    loads = [0] * n_shards
    for part, load in first.groupBy("part").agg(F.sum("bytes")).collect():
        loads[part] = load
    missing = n_shards * max(loads) - sum(loads)
    # drawn by hash, a quarter more than is missing, as a draw may come out short
    drawn_share = min(1.0, 1.25 * missing / max(1, size.bytes - sum(loads)))
    drawn = F.shiftrightunsigned(F.xxhash64("group", F.lit(1)), 32) < int(drawn_share * (1 << 32))
    level = groups.where(~large & drawn).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    gets = levelled(loads, level.bytes)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["unit"].iloc[0] > 0:
            return apart(pdf)
        own = int(pdf["bytes"].sum())
        return apart(pdf, [(max(gets) - g) * own // level.bytes for g in gets])

    def further(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="unit", columns="part", values="bytes").fillna(0).astype("int64")
        placed = difference(wide.to_numpy().tolist(), n_shards)
        rows = [(u, p, int(b), to) for u, own in zip(wide.index, placed) for p, b, to in zip(wide.columns, wide.loc[u], own)]
        return pd.DataFrame(rows, columns=["unit", "part", "bytes", "to"]).assign(above=pdf["above"].iloc[0])

    levelling = -1 - F.pmod(F.xxhash64("group"), F.lit(buckets_for(level.n, groups_per_task)))
    unit = F.when(drawn, levelling).otherwise(1 + F.pmod(F.xxhash64("group"), F.lit(units)))
    others = groups.where(~large).withColumn("unit", unit).groupBy("unit").applyInPandas(split, schema)
    placed = first.unionByName(keep(others, "partial-shards")).withColumn("unit", F.greatest("unit", F.lit(0)))
    sums = placed.groupBy("unit", "part").agg(F.sum("bytes").alias("bytes"))
    placed, units = placed.select("group", "unit", "part"), units + 1
    while units > 1:
        above = sums.withColumn("above", F.expr(f"unit div {partials_per_task}")).groupBy("above")
        moved = keep(above.applyInPandas(further, "unit long, part int, bytes long, to int, above long"), "shard-level")
        to = moved.select("unit", "part", "to", "above")
        placed = placed.join(to, ["unit", "part"]).select("group", F.col("above").alias("unit"), F.col("to").alias("part"))
        sums = moved.groupBy(F.col("above").alias("unit"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
        units = buckets_for(units, partials_per_task)
    return placed.select("group", F.col("part").alias("shard"))


def shard_by_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 24,
    groups_per_task: int = 50_000,
    partials_per_task: int = 2_000,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 length plus 8; a null text counts as an empty one and
    shares its group. Rows with equal texts share a shard; repeated rows are
    kept. Slots number a shard's rows from 0 without gaps. An empty table gives
    no rows. Other columns of ``docs`` are ignored. Rows that agree in id and
    text are spread over tasks all the same, by a stored row number. A group above the mean load of a shard makes its shard as large as itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = keep(rows, "shard-rows")
    groups = keep(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = keep(
        rows.join(assign_groups(groups, n_shards, groups_per_task, partials_per_task), "group").drop("group"), "shard-placed"
    )
    return number_within(placed, "shard", [id_col, "text_crc32", "_row"], "slot", placed.count()).drop("_row")
