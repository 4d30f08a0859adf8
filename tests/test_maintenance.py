"""Jobs from one stored snapshot to the next, marks, and what the layout is good for."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

from bibliospark.operators import maintenance
from bibliospark.schemas import DEFAULT_VENUES
from bibliospark.sources import tables
from tests.samples import NOW, make, papers


def test_declare_and_seed_twice(spark, tmp_path):
    a, b, c = (f"{tmp_path}/{n}" for n in "abc")
    assert maintenance.initialise(spark, a, b, NOW) == len(DEFAULT_VENUES)
    assert maintenance.initialise(spark, b, c, NOW) == 0
    assert tables.high_water(spark, c, "venues") == len(DEFAULT_VENUES)


def test_refresh_counts_from_root_to_root(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    tables.write_snapshot(papers(spark, 1, 2), a, "papers", 9)
    edges = make(spark, "citations", {"citing_paper_id": 2, "cited_paper_id": 1})
    tables.write_snapshot(edges, a, "citations")
    assert maintenance.refresh_counts(spark, a, b, NOW) == 2
    after = tables.read_table(spark, b, "papers").collect()
    assert {r.id: r.citation_count for r in after} == {1: 1, 2: 0}
    assert tables.high_water(spark, b, "papers") == 9


def test_the_mark_outlives_deleted_rows(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    tables.write_snapshot(papers(spark, 3, 8), a, "papers")
    left = tables.read_table(spark, a, "papers").where("id < 8")
    tables.write_snapshot(left, b, "papers", tables.high_water(spark, a, "papers"))
    assert tables.high_water(spark, b, "papers") == 8


@pytest.mark.parametrize("n", [4_000])
def test_files_of_a_snapshot_hold_ranges_of_ids(spark, tmp_path, n):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_snapshot(papers(spark, *range(n)), str(tmp_path), "papers")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bounds = []
    for file in (tmp_path / "papers").glob("part-*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            bounds.append((stats.min, stats.max))
    bounds.sort()
    assert len(bounds) > 1
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
