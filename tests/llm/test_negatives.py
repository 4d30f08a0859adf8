"""Hard negatives against scoring every pair, with hot labels, copies, odd vectors and many shards."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliospark.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, row string, windows int"


def brute(rows, every, n_positives=5, n_negatives=3):
    usable = []
    for i, label, v, *_ in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in usable)
        for minus, p, _ in [s for s in scored if s[2] and s[1] != a][:n_positives]:
            fit = [s for s in scored if not s[2] and -50 * minus <= -100 * s[0] <= -95 * minus]
            out += [(a, p, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


def rows_of(n: int, seed: int):
    """A third of the rows has one label; some vectors are copies and the others lie around a few centres."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    copies = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = 3 if i % 3 == 0 else rng.randrange(6)
        v = rng.choice(copies) if i % 5 == 0 else [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]
        rows.append((i, label, v, 1, "r", 2))
    odd = [None, [], [1.0], [None, 1.0], [math.nan, 1.0], [math.inf, 0.0], [-1.0] * 6, [0.0] * 6]
    rows += [(n + i, 3, v, 1, "r", 2) for i, v in enumerate(odd)]
    return rows + [(None, 3, [1.0] * 6, 1, "r", 2), (n + 40, None, [1.0] * 6, 1, "r", 2), rows[4], rows[12]]


def mined(df, every=4, **how):
    return sorted(map(tuple, negatives.mine_negatives(df, F.col("id") % every == 0, **how).collect()))


@pytest.mark.parametrize("shard_rows,run,together,directions", [(16_384, 64, 64, 16), (70, 5, 7, 3), (50, 8, 64, 0)])
def test_agrees_with_all_pairs(spark, monkeypatch, shard_rows, run, together, directions):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 50)
    monkeypatch.setattr(negatives, "RUN", run)
    monkeypatch.setattr(negatives, "TOGETHER", together)
    monkeypatch.setattr(negatives, "far_apart", lambda s, n, f=negatives.far_apart: f(s, n)[:directions])
    rows = rows_of(300, 1)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got and got == brute(rows, 4)


def test_few_and_no_rows(spark):
    rows = [(0, 1, [1.0, 0.0], 1, "r", 2), (1, 1, [1.0, 0.0], 1, "r", 2), (2, 0, [0.6, 0.0], 1, "r", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == [(0, 1, 1, 2, 256 * 256, 256 * 153)]
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 0")) == []
    assert mined(df.where("vec_id <> 2")) == [] and mined(df, positives=1, least=99, most=100) == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 12)) * 256
    matrix = np.floor(centres[rng.integers(0, 20, 3_000)] + rng.normal(size=(3_000, 12)) * 20)
    matrix[:50] *= 1_000
    matrix[50:60] = 0
    directions = negatives.far_apart(matrix[::7], 16)
    angles = negatives._angles(matrix, directions)
    order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))
    matrix, angles = matrix[order], angles[order]
    labels = rng.integers(0, 4, 3_000)
    shard = negatives.Shard(np.arange(3_000), labels, matrix, angles)
    anchors = shard.some(slice(100, 160))
    lower, upper = shard.intervals(anchors)
    scores = (anchors.matrix @ matrix.T).astype(np.int64)
    for run, (begin, end) in enumerate(zip(shard.starts, shard.ends)):
        assert (scores[:, begin:end] >= lower[:, run, None]).all() and (scores[:, begin:end] <= upper[:, run, None]).all()


def test_clusters_are_skipped():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    matrix = np.floor(256 * (centres[rng.integers(0, 30, 4_000)] + rng.normal(size=(4_000, 16)) * 0.02))
    directions = negatives.far_apart(matrix[:500], 16)
    angles = negatives._angles(matrix, directions)
    labels = np.zeros(4_000, np.int64)
    order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))
    shard = negatives.Shard(np.arange(4_000)[order], labels, matrix[order], angles[order])
    for at in range(0, 4_000, 500):
        shard.positives(shard.some(slice(at, at + 1)), 5)
    assert shard.scored < shard.asked / 3


def test_large_components_stay_exact(spark):
    big = float(1 << 40)
    rows = [(0, 1, [big, 1.0], 1, "r", 2), (1, 1, [1.0, 2.0], 1, "r", 2), (2, 0, [0.75, 3.0], 1, "r", 2)]
    got = mined(spark.createDataFrame(rows, SCHEMA), every=50)
    assert got == brute(rows, 50) and got
    # only the anchor's product with itself is no long, and it is no result
    huge = [(0, 1, [3e12, 1.0], 1, "r", 2), (1, 1, [1.0, 2.0], 1, "r", 2), (2, 0, [0.75, 3.0], 1, "r", 2)]
    assert mined(spark.createDataFrame(huge, SCHEMA), every=50) == brute(huge, 50)
