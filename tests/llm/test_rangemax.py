"""Ranked search against scoring every document, with copies, long texts, ties and many shards."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bibliospark.llm import rangemax
from tests.llm.samples import no_documents, odd_documents, odd_rows

ITEMS = "item_id long, text string, rank int, row string"


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=20):
    """(item, rank, id, score) as sorted strings; ``docs`` and ``items`` are pairs of id and text."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, m in counts:
            measure = 75 + (25 * m * n) // length
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * measure))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def ranked(docs, items, k=20):
    return sorted(str(tuple(r)) for r in rangemax.rank_documents(docs, items, k).collect())


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["Ärger", "x1"]
    weights = [1 / (1 + i) for i in range(len(pool))]
    rows = [(i, " ".join(rng.choices(pool, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    copy = " ".join(rng.choices(pool, k=30))
    return [(i, copy if i % 3 == 0 else t) for i, t in rows], rng, pool


@pytest.mark.parametrize("postings,query_terms,leaf", [(1 << 20, 1 << 18, 24), (1_500, 20, 3), (400, 9, 1)])
def test_agrees_with_scoring_all(spark, monkeypatch, postings, query_terms, leaf):
    monkeypatch.setattr(rangemax, "POSTINGS", postings)
    monkeypatch.setattr(rangemax, "QUERY_TERMS", query_terms)
    monkeypatch.setattr(rangemax, "LEAF", leaf)
    rows, rng, pool = corpus(400, 4)
    rows += [rows[5], rows[5], (None, rows[7][1]), (7_000, None), (7_001, "!? --")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "unknown words"), (53, "ärger ÄRGER Ärger w0"), (None, "x1 X1 w3"), (3, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame([(*i, 1, "r") for i in items], ITEMS).repartition(3)
    assert ranked(docs, asked) == brute(rows, items)


def test_odd_documents(spark):
    rows = [r[:2] for r in odd_rows()]
    items = [(1, rows[5][1]), (2, "the same line again token"), (3, "w1 w2 w3 één"), (4, rows[9][1])]
    asked = spark.createDataFrame([(*i, 1, "r") for i in items], ITEMS)
    assert ranked(odd_documents(spark), asked, 7) == brute(rows, items, 7)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "w1", 1, "r")], ITEMS)
    assert rangemax.rank_documents(no_documents(spark), items).count() == 0
    assert rangemax.rank_documents(odd_documents(spark), items.where("false")).count() == 0


def test_search_skips_documents_and_keeps_ties():
    rng = np.random.default_rng(1)
    n_docs, n_lists = 20_000, 12
    held = rng.random((n_lists, n_docs)) < np.linspace(0.001, 0.3, n_lists)[:, None]
    lists, docs = np.nonzero(held)
    shares = rng.integers(1, 1_000_000, len(docs))
    postings = rangemax.Postings(n_docs, lists, docs, shares)
    weights = np.geomspace(9_000, 10, n_lists).astype(np.int64)
    scored = []
    plain = postings.score
    postings.score = lambda li, w, d: scored.append(len(d)) or plain(li, w, d)
    found, scores = postings.search(np.arange(n_lists), weights, 20)
    full = np.zeros(n_docs, np.int64)
    np.add.at(full, docs, shares * weights[lists])
    order = np.lexsort((np.arange(n_docs), -full))[:20]
    assert found.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    assert sum(scored) < n_docs / 4
    level = rangemax.Postings(n_docs, lists, docs, np.full(len(docs), 7))
    full = np.zeros(n_docs, np.int64)
    np.add.at(full, docs, 7 * weights[lists])
    order = np.lexsort((np.arange(n_docs), -full))[:20]
    assert level.search(np.arange(n_lists), weights, 20)[0].tolist() == order.tolist()


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(rangemax, "PART", 50)
    text = " ".join(f"Wort{i % 13}é;{i % 7}" for i in range(500))
    assert rangemax.count_terms(text.encode()) == Counter(t.encode() for t in terms(text))
