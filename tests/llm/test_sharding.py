"""Differencing against plain bounds, and shards of odd documents."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from bibliospark.llm import sharding
from bibliospark.llm.sharding import difference, shard_by_bytes
from tests.llm.samples import no_documents, odd_documents, odd_rows


def test_difference_of_two_parts():
    placed = difference([[8], [7], [6], [5], [4]], 2)
    loads = [0, 0]
    for size, (part,) in zip([8, 7, 6, 5, 4], placed):
        loads[part] += size
    assert sorted(loads) == [14, 16]


def test_parts_are_even_and_partials_stay_whole():
    rng = random.Random(1)
    partials = [[rng.randrange(1, 10_000) for _ in range(rng.randrange(1, 6))] for _ in range(500)]
    placed = difference(partials, 8)
    loads = [0] * 8
    for sums, parts in zip(partials, placed):
        assert len(set(parts)) == len(parts)  # the parts of one partial partition go to different parts
        for s, p in zip(sums, parts):
            loads[p] += s
    assert max(loads) - min(loads) < 200
    assert difference([], 3) == []


def test_odd_documents(spark):
    rows = shard_by_bytes(odd_documents(spark), n_shards=3, groups_per_task=10).collect()
    texts = {r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}
    assert len(rows) == len(odd_rows())
    shard_of: dict[str, set] = {}
    slots: dict[int, list] = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            data = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
            shard_of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bytes_are_even(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(1, 3_000) + str(i % 700)) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads: dict[int, int] = {}
    for r in shard_by_bytes(docs, groups_per_task=300).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) <= 20


def test_many_levels_stay_even_and_rows_of_one_id_are_spread(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(1, 900) + str(i)) for i in range(1_500)]
    rows += [(7, "the same row")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = shard_by_bytes(docs, n_shards=5, groups_per_task=100, partials_per_task=4).collect()  # 16 units, 3 levels
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    loads: dict[int, int] = {}
    slots: dict[int, list] = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len({r.shard for r in got if r.doc_id == 7 and r.size == 20}) == 1
    assert len(loads) == 5 and max(loads.values()) - min(loads.values()) < 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_levelled_loads():
    assert sharding.levelled([0, 10, 4], 8) == [6, 0, 2]
    assert sharding.levelled([0, 0, 0], 9) == [3, 3, 3]
    assert sharding.levelled([5, 100], 0) == [0, 0]


def test_large_groups_are_made_up_for(spark):
    rng = random.Random(10)
    rows = [(i, "x" * rng.randrange(1, 400) + str(i)) for i in range(4_000)]
    for copies in ((40, 2_500), (41, 900), (42, 30)):
        rows += [(10_000 + copies[0], f"copies {copies[0]}")] * copies[1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    loads: dict[int, int] = {}
    for r in shard_by_bytes(docs, n_shards=8, groups_per_task=300).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())


def test_a_third_of_all_rows_on_one_id_fill_no_bucket_alone(spark, monkeypatch):
    rows = [(i, f"t{i}") for i in range(4_000)] + [(1, "hot")] * 2_000
    sizes = []
    plain = sharding.number_within

    def counted(df, key, tie, name, n):
        spread = df.groupBy(F.pmod(F.xxhash64(*tie), F.lit(8)).alias("bucket")).count().collect()
        sizes.extend(r["count"] for r in spread)
        return plain(df, key, tie, name, n, 750)

    monkeypatch.setattr(sharding, "number_within", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slots: dict[int, list] = {}
    for r in shard_by_bytes(docs).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(sizes) == 8 and max(sizes) < 1_000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_documents(spark):
    assert shard_by_bytes(no_documents(spark)).count() == 0


def plain_loads(partials, n_parts):
    """Differencing with whole lists: the two with the largest spread, heaviest part with lightest."""
    state = [(sorted([*p, *[0] * (n_parts - len(p))]), i) for i, p in enumerate(partials)]
    fresh = len(state)
    while len(state) > 1:
        state.sort(key=lambda s: (s[0][0] - s[0][-1], s[1]))
        (one, _), (other, _), *rest = state
        state = [*rest, (sorted(a + b for a, b in zip(one, reversed(other))), fresh)]
        fresh += 1
    return state[0][0]


def test_differencing_equals_the_plain_form():
    rng = random.Random(6)
    for n_parts in (2, 3, 24):
        for n in (1, 2, 7, 60):
            partials = [[rng.choice([1, 5, rng.randrange(1, 1_000)]) for _ in range(rng.randrange(1, min(4, n_parts + 1)))] for _ in range(n)]
            loads = [0] * n_parts
            for sums, parts in zip(partials, difference(partials, n_parts)):
                for s, p in zip(sums, parts):
                    loads[p] += s
            assert sorted(loads) == plain_loads(partials, n_parts)
