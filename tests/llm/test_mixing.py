"""Targets by filling up, positions by integrating, and what the mix takes."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliospark.llm import mixing
from tests.llm.samples import no_documents, odd_documents, odd_rows


def test_targets_reshare_what_is_above_the_cap():
    sizes, weights = [100, 10, 50, 0], [3, 1, 2, 3]
    got = mixing.targets(sizes, weights, 240.0, 2)
    assert sum(got) == pytest.approx(240) and got[3] == 0
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
    free = [t / w for t, s, w in zip(got, sizes, weights) if 0 < t < 2 * s]
    full = [t / w for t, s, w in zip(got, sizes, weights) if t and t >= 2 * s]
    assert len(set(np.round(free, 9))) <= 1 and all(f <= min(free) + 1e-9 for f in full)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_demand_inverts(spark, knots):
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    rows = df.select("u", mixing.invert_demand(F.col("u"), knots).alias("t")).collect()
    at = np.linspace(0, 1, 100_001)
    heights = np.interp(at, *zip(*knots))
    done = np.concatenate([[0], np.cumsum((heights[1:] + heights[:-1]) / 2 * np.diff(at))])
    for r in rows:
        assert np.interp(r.t, at, done / done[-1]) == pytest.approx(r.u, abs=1e-4)


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_rows())
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd_rows() if r[0] is not None}
    by_source = {}
    for r in rows:
        assert r.doc_id is None or r.size == size[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        assert sum(r.size for r in own) == own[0].source_size
        smallest_left = min((r.size for r in own if r.size and r.copies < 2), default=0)
        short = own[0].target - sum(r.taken for r in own)
        assert -1 < short < max(1, smallest_left) + own[0].target * 1e-3
    again = mixing.mix(odd_documents(spark, 7)).collect()
    pick = lambda rs: sorted(str((r.doc_id, r.size, r.taken, r.positions)) for r in rs)
    assert pick(rows) == pick(again)


@pytest.mark.parametrize("seed", range(4))
def test_no_document_left_fits_beside_a_dominant_one(spark, seed):
    # all words once and half of them again, 9,890: past the first 1,890 the long document leaves a gap of up to its size
    rows = [(i, " ".join(["w"] * n), "s") for i, n in enumerate([8_000, 3_000, *[40] * 200, *range(1, 40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(docs, seed=seed).collect()
    left = [r.size for r in mixed if r.copies == 1]
    short = mixed[0].target - sum(r.taken for r in mixed)
    assert -1 < short < min(left) + 1
    places = sorted((p, r.size) for r in mixed for p in r.positions)
    assert len({p for p, _ in places}) == len(places)


def test_documents_come_in_order_as_often_as_taken(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs).collect()
    assert {i: n for i, n in copies.items() if n} == {
        i: sum(r.doc_id == i for r in rows) for i in {r.doc_id for r in rows}
    }
    ordered = mixing.in_training_order(mixing.mix(docs)).orderBy("place").collect()
    assert [r.place for r in ordered] == list(range(len(rows)))
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    assert [r.doc_id for r in ordered] == [r.doc_id for r in rows]


def test_other_columns_stay_as_they_are(spark):
    extra = ("text_hash", "nth", "position", "mix_source", "id_value", "has_id", "_hash", "_n", "size", "target")
    rows = [(i, f"some words {i % 4}", "s", *[f"{c}{i}" for c in extra]) for i in range(12)]
    rows += [rows[3], (None, "no id", "s", *extra), (None, None, "s", *extra)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixed_documents(docs, share=2.0)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == set(rows)


def test_no_documents(spark):
    assert mixing.mix(no_documents(spark)).count() == 0
    assert mixing.mixed_documents(no_documents(spark)).count() == 0


def plain_mix(rows, orders, weights, schedules):
    """Words taken and positions of each document, source by source in plain Python."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, s in rows if s == source) for source in sources]
    heights = [weights[i % len(weights)] for i in range(len(sources))]
    low, high = 0.0, 1e9  # the unit whose shares, cut at twice a source, add up to what is wanted
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(unit * h, 2 * n) for h, n in zip(heights, sizes)) < 1.5 * sum(sizes) else (low, unit)
    out = {}
    for at, (source, size, height) in enumerate(zip(sources, sizes, heights)):
        target = min(low * height, 2 * size)
        own = sorted((orders[i], i, n) for i, n, s in rows if s == source and n)
        base = min(2, int(target / size + 1e-9)) if size else 0
        extra = 0 if base == 2 else round(target - base * size)
        starts, end = {i: [] for _, i, _ in own}, 0
        for _, i, n in own:
            starts[i] += [e * size + end for e in range(base)]
            end += n
        left, reached, first = own, 0, True
        while True:
            fits = left if first else [d for d in left if d[2] <= extra - reached]
            taken, end = [], 0
            for d in fits:
                end += d[2]
                if end <= extra - reached:
                    taken.append((d, end - d[2]))
            if not taken and not first:
                break
            for (_, i, _), place in taken:
                starts[i].append(base * size + reached + place)
            reached += sum(d[2] for d, _ in taken)
            left, first = [d for d in left if d not in [t for t, _ in taken]], False
        knots = schedules[at % len(schedules)]
        grid = np.linspace(0, 1, 200_001)
        heights_at = np.interp(grid, *zip(*knots))
        done = np.concatenate([[0], np.cumsum((heights_at[1:] + heights_at[:-1]) / 2 * np.diff(grid))])
        for _, i, n in own:
            out[i] = n * len(starts[i]), sorted(np.interp([x / target for x in starts[i]], done / done[-1], grid))
    return out


def test_the_whole_mix_equals_a_plain_one(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(1, 60)), ["a", "b", "c", None][int(rng.integers(0, 4)) if i % 3 else 0]) for i in range(160)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in rows], "doc_id long, text string, source string")
    orders = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("o")).collect()}
    wanted = plain_mix(rows, orders, mixing.WEIGHTS, mixing.SCHEDULES)
    got = {r.doc_id: (r.taken, sorted(r.positions)) for r in mixing.mix(docs.repartition(3)).collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in wanted.items()}
    for i, (_, positions) in got.items():
        assert positions == pytest.approx(wanted[i][1], abs=1e-4)


def test_very_many_rows_of_one_id_are_spread_and_reruns_agree(spark):
    # a third of the rows share an id: half of them one text, the others a text each of one size
    rows = [(7, "the same words" if i % 2 else f"other words {i}", "s") for i in range(3_000)]
    rows += [(None, "no id here", "s")] * 50 + [(i, f"some words {i} " * (i % 5 + 1), "st"[i % 2]) for i in range(100, 6_100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = docs.select(
        "doc_id", "source", F.length("text").cast("long").alias("size"), F.xxhash64(F.lit(7), "doc_id").alias("_order"),
        F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"),
    )
    ordered = mixing._ordered(narrow, 7)
    assert ordered.count() == len(rows) == ordered.select("_order").distinct().count()
    eighths = ordered.where("doc_id = 7").groupBy(F.shiftrightunsigned("_order", 61)).count().collect()
    assert len(eighths) == 8 and max(r["count"] for r in eighths) < 2 * 3_000 / 8

    def taken(parts):
        mixed = mixing.mixed_documents(docs.repartition(parts))
        return [tuple(r) for r in mixed.collect()]

    first = taken(3)
    assert sorted(map(str, first)) == sorted(map(str, taken(11)))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and sum(r.copies for r in mixed) == len(first)
    assert all(r.copies <= 2 for r in mixed)
