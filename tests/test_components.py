"""Connected components of paths, stars and random graphs."""

from __future__ import annotations

import random

from bibliospark.operators.components import connected_components


def brute(edges: list[tuple[int, int]]) -> dict[int, int]:
    low = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def components(spark, edges, n=4):
    df = spark.createDataFrame(edges, "a long, b long").repartition(n)
    rows = [(r.node, r.component) for r in connected_components(df).collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def test_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1_000, i) for i in range(1_001, 1_300)]
    random.Random(0).shuffle(path)
    assert components(spark, path + star) == brute(path + star)


def test_random_graph_with_loops_and_repeats(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    edges += edges[:20] + [(7_000, 7_000)] + [(b, a) for a, b in edges[:20]]
    assert components(spark, edges) == brute(edges)


def test_no_edges_and_nulls(spark):
    assert components(spark, []) == {}
    assert components(spark, [(None, 1), (2, None)]) == {}
