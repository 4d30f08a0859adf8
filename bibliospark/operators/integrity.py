"""Integrity rules on a batch: which rows a table takes, and why it refuses the others.

The outcome equals that of inserting the rows one by one in the order of a
column the caller names; rows without a value there, or with one that another
row has too, are refused. All checks run on the key columns alone; the wide
rows are joined once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliospark.functions.scalars import is_malformed_json, json_to_array
from bibliospark.operators import spread
from bibliospark.operators.components import connected_components
from bibliospark.schemas import Rules
from bibliospark.sources.durable import keep

FAULT = "struct<reason:string,key:string>"

#: Claims of one component that a task takes as a stream, beyond which parallel rounds go on.
STREAMED = 100_000
#: A round on large components must settle one claim in so many to be worth another.
LEAST_PROGRESS = 8


def fault(reason: str, key: str) -> Column:
    return F.struct(F.lit(reason).alias("reason"), F.lit(key).alias("key")).cast(FAULT)


def first_fault(checks: list[tuple[Column, Column]]) -> Column:
    """The fault of the first failing check, NULL if none fails."""
    return F.coalesce(*(F.when(bad, what) for bad, what in checks), F.lit(None).cast(FAULT))


def conform(batch: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Cast the batch to the table's types.

    Returns the cast batch and the checks, on the uncast one, that find values
    which cannot be cast: text that is no number, or no JSON array.
    """
    columns, checks = [], []
    for name in batch.columns:
        given = batch.schema[name].dataType
        wanted = schema[name].dataType if name in schema.fieldNames() else given
        value = F.col(name)
        if given == wanted:
            columns.append(value)
        elif isinstance(wanted, T.ArrayType) and isinstance(given, T.StringType):
            element = wanted.elementType.simpleString()
            columns.append(json_to_array(value, element).alias(name))
            checks.append((is_malformed_json(value, element), fault("malformed_json", name)))
        elif isinstance(wanted, T.ArrayType):
            columns.append(value.cast(wanted).alias(name))
        else:
            cast = value.try_cast(wanted)
            columns.append(cast.alias(name))
            checks.append((value.isNotNull() & cast.isNull(), fault("type", name)))
    return batch.select(*columns), checks


def split_order(batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose order value is theirs alone, and one refusal for each of the others."""
    repeated = keep(
        batch.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("_n")).where("_n > 1").select(order),
        "repeated-order",
    )
    alone = batch.where(F.col(order).isNotNull()).join(repeated, order, "left_anti")
    missing = batch.where(F.col(order).isNull()).select(
        order, F.lit("order_null").alias("reason"), F.lit(order).alias("key")
    )
    several = batch.join(repeated, order, "left_semi").select(
        order, F.lit("order_repeated").alias("reason"), F.lit(order).alias("key")
    )
    return alone.select(*batch.columns), missing.unionByName(several)


def row_checks(rules: Rules, columns: list[str]) -> list[tuple[Column, Column]]:
    """NOT NULL, then allowed values; a missing required column is NULL in every row."""
    missing = [
        (F.col(c).isNull() if c in columns else F.lit(True), fault("not_null", c))
        for c in rules.required
    ]
    outside = [
        (F.coalesce(~F.col(c).isin(*allowed), F.lit(False)), fault("check", c))
        for c, allowed in rules.domains.items()
        if c in columns
    ]
    return missing + outside


def has_key(key: tuple[str, ...]) -> Column:
    """A key with a NULL in it clashes with nothing."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])


def _key_text(key: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*key)) if len(key) > 1 else F.col(key[0]).cast("string")


def _present(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys of ``keys`` that ``table`` has, one row each.

    The keys are made distinct before they are shuffled. A small batch against
    a large table then broadcasts its keys and leaves the table in place.
    """
    on = keys.columns
    return table.select(*on).join(keys.distinct(), on, "left_semi").distinct()


def orphans(
    rows: DataFrame, column: str, parent: DataFrame, flag: str
) -> DataFrame:
    """Add ``flag``: true where ``column`` names no ``id`` of ``parent``; NULL names nothing."""
    ids = parent.select(F.col("id").alias(column))
    wanted = rows.where(F.col(column).isNotNull()).select(column)
    found = _present(ids, wanted).withColumn("_found", F.lit(True))
    joined = spread.join(rows, found, column, "left")
    return joined.withColumn(flag, F.col(column).isNotNull() & F.col("_found").isNull()).drop(
        "_found"
    )


def first_come(rows: DataFrame, order: str, keys: list[tuple[str, ...]]) -> DataFrame:
    """The rows that sequential insertion into an empty table accepts.

    A refused row does not occupy its other keys, so a refusal may let a later
    row in, and so on along a chain. One parallel round settles most claims:
    a row that comes first on all its keys is in, rows that share a key with
    it are out. What is still open falls into connected components of rows and
    the keys they share, which do not touch each other: a component of at most
    ``STREAMED`` claims is taken in order, as a sorted stream, by one task. The number of
    rounds for these does not depend on the length of chains. Claims of larger components go
    through further parallel rounds, see :func:`_settle_deep`, until the
    components left are small. Only where a round settles less than a
    ``LEAST_PROGRESS``-th of them are large ones streamed as well: they are
    sequential by nature, and a task holds no more than the keys that are taken.
    """
    claims = [
        F.when(has_key(key), F.struct(F.lit(i).alias("slot"), _key_text(key).alias("value")))
        for i, key in enumerate(keys)
    ]
    claimed = rows.select(order, F.array_compact(F.array(*claims)).alias("claims"))
    accepted = claimed.where(F.size("claims") == 0).select(order)
    wanted = claimed.select(order, F.size("claims").alias("need"), F.inline("claims"))
    decided = keep(_settle(wanted, order), "round")
    accepted = accepted.unionByName(decided.where("won").select(order).distinct())
    still_open = decided.where(~(F.col("won") | F.col("lost"))).select(*wanted.columns)
    while not still_open.isEmpty():
        placed = _components(still_open, order)
        large = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > STREAMED)
        large = keep(large.select("component"), "large-components")
        if large.isEmpty():
            return accepted.unionByName(keep(_stream(placed, order), "components-settled"))
        small = placed.join(large, "component", "left_anti")
        accepted = accepted.unionByName(keep(_stream(small, order), "components-settled"))
        deep = keep(placed.join(large, "component", "left_semi").select(*wanted.columns), "large-claims")
        decided = keep(_settle_deep(deep, order), "deep-round")
        accepted = accepted.unionByName(decided.where("won").select(order).distinct())
        still_open = decided.where(~(F.col("won") | F.col("lost"))).select(*wanted.columns)
        before, after = deep.count(), still_open.count()
        if (before - after) * LEAST_PROGRESS < before:
            left = _components(still_open, order)
            return accepted.unionByName(keep(_stream(left, order), "components-settled"))
    return accepted


def _settle(claims: DataFrame, order: str) -> DataFrame:
    """One round: mark the claims of rows that have ``won`` all their keys or ``lost`` one."""
    firsts = claims.groupBy("slot", "value").agg(
        F.min(order).alias("_holder"), F.min_by("need", order).alias("need")
    )
    firsts = keep(firsts, "firsts")
    winners = (
        firsts.groupBy("_holder")
        .agg(F.count("*").alias("n"), F.first("need").alias("need"))
        .where(F.col("n") == F.col("need"))
    )
    taken = firsts.join(winners, "_holder", "left_semi").select("slot", "value", "_holder")
    return _marked(claims, taken, order)


def _marked(claims: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """Mark the claims of rows that hold all their keys in ``taken``, and of rows with a key that another holds."""
    marked = claims.join(taken, ["slot", "value"], "left")
    of_row = Window.partitionBy(order)
    mine = F.col("_holder") == F.col(order)
    return marked.select(
        *claims.columns,
        F.min(F.coalesce(mine, F.lit(False))).over(of_row).alias("won"),
        F.max(F.coalesce(~mine, F.lit(False))).over(of_row).alias("lost"),
    )


def _settle_deep(claims: DataFrame, order: str) -> DataFrame:
    """One round that also settles chains: mark the claims of rows that have ``won`` or ``lost``.

    A row that is first on all its keys but one, and second there, is in
    exactly if the first row on that key is out. Following such rows leads to one that is in
    for certain, or to one that is not settled yet; the number of steps to it
    tells the outcome. Pointers are doubled, so a chain of n rows takes about log n
    joins. Rows that share a key with one that is in are out.
    """
    places = claims.groupBy("slot", "value").agg(F.min(order).alias("_first"))
    places = keep(places, "deep-firsts")
    behind = claims.join(places, ["slot", "value"]).where(F.col(order) > F.col("_first"))
    seconds = behind.groupBy("slot", "value").agg(F.min(order).alias("_second"))
    placed = claims.join(places.join(seconds, ["slot", "value"], "left"), ["slot", "value"])
    ahead = F.col("_first") < F.col(order)
    rows = keep(
        placed.groupBy(order).agg(
            F.count_if(ahead).alias("behind"),
            F.max(F.when(F.col("_second") == F.col(order), F.col("_first"))).alias("up"),
        ),
        "deep-rows",
    )
    sure = rows.where("behind = 0").select(F.col(order).alias("root"))
    chained = rows.where("behind = 1 AND up IS NOT NULL").select(F.col(order).alias("row"), "up", F.lit(1).alias("steps"))
    chained = keep(chained, "chains")
    while True:
        further = chained.select(F.col("row").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
        longer = chained.join(further, "up", "left").select(
            "row",
            F.coalesce("top", "up").alias("up"),
            # only whether the number of steps is odd matters
            ((F.col("steps") + F.coalesce("more", F.lit(0))) % 2).alias("steps"),
            F.col("top").isNotNull().alias("moved"),
        )
        longer = keep(longer, "chains")
        chained = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    by_chain = chained.join(sure, chained["up"] == sure["root"], "left_semi").where("steps = 0")
    winners = keep(sure.select(F.col("root").alias("_holder")).unionByName(by_chain.select(F.col("row").alias("_holder"))), "deep-winners")
    taken = claims.join(winners, claims[order] == winners["_holder"]).select("slot", "value", "_holder")
    return _marked(claims, keep(taken, "deep-taken"), order)


def _components(claims: DataFrame, order: str) -> DataFrame:
    """The claims with the connected component of rows and keys that each belongs to; stored."""
    row = F.xxhash64(F.lit("row"), order)
    edges = claims.select(row.alias("a"), F.xxhash64(F.lit("key"), "slot", "value").alias("b"))
    parts = connected_components(edges)
    placed = claims.withColumn("node", row).join(parts, "node").drop("node")
    return keep(placed, "open-claims")


def _stream(placed: DataFrame, order: str) -> DataFrame:
    """Take the rows of each connected component one by one, all components at once."""
    streamed = (
        placed.select("component", order, "slot", "value")
        .repartition("component")
        .sortWithinPartitions("component", order)
    )

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, held, current, wanted = None, set(), None, set()

        def settled() -> list:
            if current is None or not held.isdisjoint(wanted):
                return []
            held.update(wanted)
            return [current]

        for batch in batches:
            accepted = []
            for part, at, slot, value in batch.itertuples(index=False, name=None):
                if part != component or at != current:
                    accepted += settled()
                    if part != component:
                        component, held = part, set()
                    current, wanted = at, set()
                wanted.add((slot, value))
            yield pd.DataFrame({order: accepted})
        yield pd.DataFrame({order: settled()})

    return streamed.mapInPandas(take, T.StructType([placed.schema[order]]))


def judge(
    batch: DataFrame,
    order: str,
    rules: Rules,
    target: DataFrame | None = None,
    parents: dict[str, DataFrame] | None = None,
    extra_checks: list[tuple[Column, Column]] | None = None,
) -> DataFrame:
    """One row (``order``, ``reason``, ``key``) per row of the batch; no reason means accepted.

    Reasons come in the order type, not_null, check, duplicate, foreign_key.
    ``batch`` is the uncast batch and ``extra_checks`` are those of
    :func:`conform`. The result is stored: executors may be lost after it.
    """
    checks = [*(extra_checks or []), *row_checks(rules, batch.columns)]
    references = [c for c in rules.references if c in batch.columns]
    unique = [k for k in rules.unique if all(c in batch.columns for c in k)]
    needed = dict.fromkeys([order, *references, *(c for k in unique for c in k)])
    rows = batch.select(*needed, first_fault(checks).alias("_fault"))
    if target is not None or parents:
        types = {f.name: f.dataType for t in [target] if t is not None for f in t.schema.fields}
        types |= {c: T.LongType() for c in references}
        rows = rows.select(
            *(F.col(c).try_cast(types[c]).alias(c) if c in types and c != order else c for c in rows.columns)
        )
    orphan = F.lit(None).cast(FAULT)
    if parents:
        for column in references:
            parent = parents[rules.references[column]]
            rows = orphans(rows, column, parent, f"_orphan_{column}")
        orphan = first_fault([(F.col(f"_orphan_{c}"), fault("foreign_key", c)) for c in references])
    rows = rows.withColumn("_orphan", orphan).drop(*(f"_orphan_{c}" for c in references))
    stored = {key: f"_stored_{i}" for i, key in enumerate(unique)}
    for key, flag in stored.items():
        rows = _mark_stored(rows, key, target, flag)
    if len(unique) > 1 or (unique and (parents or target is not None)):
        rows = keep(rows, "keys")
    contenders = rows.where(F.col("_fault").isNull() & F.col("_orphan").isNull())
    if len(unique) > 1:
        fresh = contenders.where(~reduce(lambda a, b: a | b, map(F.col, stored.values())))
        admitted = first_come(fresh, order, unique)
        contenders = contenders.join(admitted, order, "left_semi")
    clash = F.lit(None).cast(FAULT)
    for i, (key, flag) in enumerate(stored.items()):
        held = contenders.where(has_key(key)).groupBy(*key).agg(F.min(order).alias(f"_holder_{i}"))
        rows = spread.join(rows, held, list(key), "left")
        clashes = F.col(flag) | F.coalesce(F.col(f"_holder_{i}") < F.col(order), F.lit(False))
        clash = F.coalesce(clash, F.when(clashes, fault("duplicate", ",".join(key))))
    verdict = F.coalesce("_fault", clash, "_orphan").alias("_v")
    return keep(rows.select(order, verdict).select(order, "_v.reason", "_v.key"), "verdicts")


def _mark_stored(
    rows: DataFrame, key: tuple[str, ...], target: DataFrame | None, flag: str
) -> DataFrame:
    """Add ``flag``: true where ``target`` has the key already."""
    if target is None:
        return rows.withColumn(flag, F.lit(False))
    present = _present(target, rows.where(has_key(key)).select(*key))
    stored = present.withColumn(flag, F.lit(True))
    marked = spread.join(rows, stored, list(key), "left")
    return marked.withColumn(flag, F.coalesce(flag, F.lit(False)))
