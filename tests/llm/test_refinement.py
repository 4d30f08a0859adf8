"""Exact copies against grouping whole texts, with hot groups, equal starts, nulls and repeated rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bibliospark.llm import refinement
from tests.llm.samples import no_documents, odd_documents, odd_rows


def brute(rows):
    """(id, keep_id, size, digest) of each row, and how many rows of a group stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        out += [(i, last, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(df, rows, every=True):
    got = df.collect()
    wanted, n_groups = brute(rows)
    mine = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    if every:
        assert sorted(mine, key=str) == wanted
    else:
        assert sorted((m[:3] for m in mine), key=str) == sorted((w[:3] for w in wanted), key=str)
        assert all(r.text_sha256 for r in got if r.group_size > 1)
    assert sum(r.kept for r in got) == n_groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    return got


@pytest.mark.parametrize("every", [True, False])
def test_odd_documents(spark, every):
    rows = [r[:2] for r in odd_rows()]
    got = check(refinement.find_copies(odd_documents(spark), every_digest=every), rows, every)
    if not every:
        assert any(r.text_sha256 is None for r in got)


def test_equal_lengths_and_starts_are_told_apart(spark):
    same = "s" * 100
    rows = [(i, same + f"{i % 7:03d}") for i in range(300)] + [(1_000 + i, f"{i % 5:03d}" + same) for i in range(60)]
    rows += [(2_000 + i, "é" * i) for i in range(4)] + [(3_000, "e" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(refinement.find_copies(docs, every_digest=True), rows)


def test_a_third_in_one_group_and_on_one_id(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 400}") for i in range(1_200)] + [(7, "hot text")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = check(refinement.find_copies(docs), rows, every=False)
    assert max(r.group_size for r in got) == 700


def test_normalized_texts(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = refinement.find_copies(docs, normalize=F.lower).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in got] == [(2, 2, False), (2, 2, True), (3, 1, True)]


def test_no_documents(spark):
    assert refinement.find_copies(no_documents(spark)).count() == 0
