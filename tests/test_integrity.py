"""Batch rules against one-by-one insertion in plain Python."""

from __future__ import annotations

import random

import pytest

from bibliospark.operators import integrity
from bibliospark.operators.integrity import first_come, judge
from bibliospark.schemas import RULES
from tests.samples import make, papers


def insert_one_by_one(rows, stored, venues):
    """What a table with unique arxiv_id and doi and a venue reference accepts."""
    taken = [{r[1] for r in stored} - {None}, {r[2] for r in stored} - {None}]
    verdicts = {}
    for seq, arxiv_id, doi, venue_id, status in rows:
        if status == "bad":
            verdicts[seq] = ("check", "status")
        elif arxiv_id in taken[0]:
            verdicts[seq] = ("duplicate", "arxiv_id")
        elif doi in taken[1]:
            verdicts[seq] = ("duplicate", "doi")
        elif venue_id is not None and venue_id not in venues:
            verdicts[seq] = ("foreign_key", "venue_id")
        else:
            verdicts[seq] = (None, None)
            taken[0] |= {arxiv_id} - {None}
            taken[1] |= {doi} - {None}
    return verdicts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_papers_as_one_by_one(spark, seed):
    draw = random.Random(seed)

    def key(kinds):
        # A third of the rows share one key, some have none.
        return draw.choice([None, "hot", "hot", *(f"k{draw.randrange(kinds)}" for _ in range(4))])

    rows = [
        (seq, key(60), key(40), draw.choice([None, 1, 2, 9]), draw.choice(["ready", None, "bad"]))
        for seq in draw.sample(range(10_000), 400)
    ]
    stored = [(i, f"k{i}", None if i % 2 else f"k{i + 3}") for i in range(5)]
    batch = spark.createDataFrame(
        rows, "seq bigint, arxiv_id string, doi string, venue_id bigint, status string"
    )
    batch = batch.selectExpr("*", "'t' as title")
    target = make(
        spark, "papers", *({"id": i, "title": "t", "arxiv_id": a, "doi": d} for i, a, d in stored)
    )
    venues = make(spark, "venues", *({"id": i, "name": str(i), "type": "journal"} for i in (1, 2)))
    verdicts = judge(batch, "seq", RULES["papers"], target, {"venues": venues})
    got = {r.seq: (r.reason, r.key) for r in verdicts.collect()}
    assert got == insert_one_by_one(sorted(rows), stored, {1, 2})


def test_refused_row_does_not_occupy_its_other_key(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, None, None), (5, None, None)],
        "seq bigint, arxiv_id string, doi string",
    )
    accepted = first_come(rows, "seq", [("arxiv_id",), ("doi",)])
    assert sorted(r.seq for r in accepted.collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("n", [200, 40_000])
def test_chain_of_clashes(spark, monkeypatch, n):
    """Each row shares a key with the next one, so every other row is in, in as many steps at any length."""
    kept = []
    monkeypatch.setattr(integrity, "keep", lambda df, label, keep=integrity.keep: kept.append(label) or keep(df, label))
    rows = spark.range(0, n, 1, 4).selectExpr(
        "id as seq", "concat('a', id div 2) as arxiv_id", "concat('d', (id + 1) div 2) as doi"
    )
    accepted = first_come(rows, "seq", [("arxiv_id",), ("doi",)])
    assert sorted(r.seq for r in accepted.collect()) == list(range(0, n, 2))
    assert kept == ["firsts", "round", "open-claims", "large-components", "components-settled"]


def accepted_one_by_one(rows):
    taken, accepted = (set(), set()), []
    for seq, *values in sorted(rows):
        if any(v is not None and v in t for v, t in zip(values, taken)):
            continue
        accepted.append(seq)
        for v, t in zip(values, taken):
            t.add(v)
    return accepted


def clashes(kind, n, seed):
    draw = random.Random(seed)
    if kind == "chain":
        return [(i, f"a{i // 2}", f"d{(i + 1) // 2}") for i in range(n)]
    if kind == "hot":  # the first row of the hot key is second on its other key
        return [(0, "a0", "first"), (1, "a0", "hot")] + [(i, f"a{i}", "hot" if i % 3 == 0 else f"d{i}") for i in range(2, n)]
    if kind == "late":  # each row of the hot key is out for its other key before the next one may be in
        return [(i, f"a{i // 2}", "hot" if i % 2 else f"d{i}") for i in range(n)]
    pool = max(2, n // 3)
    return [
        (i, draw.choice([None, "hot", f"a{draw.randrange(pool)}"]), draw.choice([None, f"d{draw.randrange(pool)}"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("kind", ["chain", "hot", "late", "random"])
@pytest.mark.parametrize("seed", [1])
def test_large_components_are_settled_in_parallel_rounds(spark, monkeypatch, kind, seed):
    kept, streamed = [], []
    monkeypatch.setattr(integrity, "keep", lambda df, label, keep=integrity.keep: kept.append(label) or keep(df, label))
    monkeypatch.setattr(
        integrity, "_stream", lambda df, order, stream=integrity._stream: streamed.append(df) or stream(df, order)
    )
    monkeypatch.setattr(integrity, "STREAMED", 30)
    rows = clashes(kind, 600, seed)
    draw = random.Random(seed)
    batch = spark.createDataFrame(draw.sample(rows, len(rows)), "seq bigint, arxiv_id string, doi string").repartition(5)
    accepted = first_come(batch, "seq", [("arxiv_id",), ("doi",)])
    assert sorted(r.seq for r in accepted.collect()) == accepted_one_by_one(rows)
    if kind in ("chain", "hot"):
        assert "deep-round" in kept
        assert all(df.groupBy("component").count().where("count > 30").isEmpty() for df in streamed)


def test_a_chain_is_followed_to_its_end_in_one_round(spark):
    claims = [(i, 2, slot, value) for i, a, d in clashes("chain", 50, 0) for slot, value in ((0, a), (1, d))]
    df = spark.createDataFrame(claims, "seq bigint, need int, slot int, value string")
    decided = integrity._settle_deep(df, "seq").collect()
    assert {r.seq for r in decided if r.won} == set(range(0, 50, 2))
    assert {r.seq for r in decided if r.lost} == set(range(1, 50, 2))


def test_missing_required_column(spark):
    batch = spark.createDataFrame([(1, 5)], "seq bigint, year int")
    (row,) = judge(batch, "seq", RULES["papers"]).collect()
    assert (row.reason, row.key) == ("not_null", "title")


def test_row_with_bad_reference_holds_no_key(spark):
    batch = spark.createDataFrame(
        [(1, 1, 9), (2, 1, 2), (3, 1, 2), (4, 8, 2)],
        "seq bigint, citing_paper_id bigint, cited_paper_id bigint",
    )
    verdicts = judge(
        batch, "seq", RULES["citations"], make(spark, "citations"), {"papers": papers(spark, 1, 2)}
    )
    assert {r.seq: r.reason for r in verdicts.collect()} == {
        1: "foreign_key",
        2: None,
        3: "duplicate",
        4: "foreign_key",
    }


def test_rows_without_an_order_of_their_own_are_refused(spark):
    batch = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (2, "d")], "seq bigint, name string")
    alone, refused = integrity.split_order(batch, "seq")
    assert [tuple(r) for r in alone.collect()] == [(2, "d")]
    assert sorted((r.seq or 0, r.reason) for r in refused.collect()) == [
        (0, "order_null"),
        (1, "order_repeated"),
        (1, "order_repeated"),
    ]
