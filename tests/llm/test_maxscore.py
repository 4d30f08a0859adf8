"""Top-k against scoring every pair, with ties, odd vectors and many shards."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliospark.llm import maxscore

SCHEMA = "vec_id long, embedding array<double>, rank int"


def brute(rows, k, every):
    usable = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q, a in usable:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows_of(n: int, seed: int):
    rng = random.Random(seed)
    some = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(n // 2)]
    rows = [(i, rng.choice(some) if i % 3 else [round(rng.gauss(0, 1), 1) for _ in range(6)], 1) for i in range(n)]
    odd = [None, [], [1.0], [None, 1.0], [math.nan, 1.0], [math.inf, 0.0], [-1.0] * 6]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)] + [(None, [1.0] * 6, 1), rows[3]]


@pytest.mark.parametrize("shard_rows,first", [(16_384, 512), (100, 7), (60, 3)])
def test_agrees_with_all_pairs(spark, monkeypatch, shard_rows, first):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(maxscore, "FIRST_ROWS", first)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 40)
    rows = rows_of(600, 1)
    got = maxscore.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5, 5)


def test_pruning_keeps_the_best_of_large_shards():
    rng = np.random.default_rng(0)
    matrix = rng.integers(-256, 256, (5_000, 16))
    matrix[1_000:1_300] = matrix[7]
    shard = maxscore.Shard(np.arange(5_000), matrix)
    for own in (7, 50, 4_999):
        ids, scores = shard.search(own, matrix[own], 5)
        all_scores = matrix @ matrix[own]
        order = [i for i in np.lexsort((np.arange(5_000), -all_scores)) if i != own][:5]
        assert ids.tolist() == order and scores.tolist() == all_scores[order].tolist()


def test_large_components_stay_exact():
    matrix = np.array([[1 << 27, 3], [1 << 27, 5], [(1 << 27) - 1, 9]])
    ids, scores = maxscore.Shard(np.arange(3), matrix).search(9, np.array([1 << 27, 1]), 3)
    assert ids.tolist() == [1, 0, 2] and scores[0] - scores[1] == 2


def test_components_of_any_size_that_scores_allow(spark):
    big = [3e6, -3e6, 1e13, 2.0**54, 0.25]
    rng = random.Random(8)
    rows = [(i, [rng.choice(big) if j == i % 3 and i % 4 == 0 else float(rng.randrange(-2, 3)) / 256 for j in range(3)], 1) for i in range(60)]
    rows = [(i, [x if abs(x) < 1e15 or i == 0 else 0.5 for x in v], 1) for i, v, _ in rows]
    rows = [(i, [x / 1e6 if abs(x) > 1e12 and i else x for x in v], 1) for i, v, _ in rows]
    got = maxscore.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5, 5)


def test_scores_beyond_long_are_refused():
    matrix = np.array([[1 << 40, 0], [1, 1 << 40], [-(1 << 40), 1 << 30]])
    shard = maxscore.Shard(np.arange(3), matrix)
    with pytest.raises(ValueError):
        shard.search(9, np.array([1 << 24, 0]), 2)
    ids, scores = shard.search(9, np.array([1 << 22, 1 << 22]), 3)
    assert ids.tolist() == [1, 0, 2]
    assert scores.tolist() == [(1 << 62) + (1 << 22), 1 << 62, -(1 << 62) + (1 << 52)]


def test_few_and_no_candidates(spark):
    two = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    rows = maxscore.top_k(two, F.col("id") % 50 == 0, 5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 1)]
    assert maxscore.top_k(two.where("false"), F.col("id") % 50 == 0, 5).count() == 0
    assert maxscore.top_k(two.where("vec_id = 0"), F.col("id") % 50 == 0, 5).count() == 0
