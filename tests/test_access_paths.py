"""What bloom filters, partitions, the curve, buckets and id ranges spare a read or a write."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bibliospark.operators import changes, graph, listing, lookup, maintenance, nested
from bibliospark.schemas import PAPER_COLS, PAPER_STATUSES, TABLES
from bibliospark.sources import buckets, queues, ranges, tables
from tests.samples import NOW, make

#: Small row groups, so that few rows make many of them.
SMALL = {"parquet.block.size": str(64 * 1024)}


@pytest.fixture(scope="module")
def many(spark):
    """20,000 papers whose DOI, status, venue and year are in no order of their ids."""
    rows = spark.range(0, 20_000, 1, 8).select(
        "id",
        F.concat(F.lit("paper "), "id").alias("title"),
        F.sha2(F.concat(F.lit("text"), F.col("id")), 512).alias("full_text"),
        F.when(F.col("id") % 97 != 0, F.pmod(F.xxhash64("id"), F.lit(50))).alias("venue_id"),
        F.when(F.col("id") % 89 != 0, (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)) + 1990).cast("int")).alias("year"),
        F.concat(F.lit("10/"), F.sha2(F.col("id").cast("string"), 256)).alias("doi"),
        F.when(F.col("id") % 11 != 0, F.element_at(F.array(*map(F.lit, PAPER_STATUSES)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(8)).cast("int") + 1)).alias("status"),
    )
    known = {f.name for f in rows.schema}
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["papers"] if f.name not in known]
    return rows.select("*", *rest).select(*PAPER_COLS)


@pytest.fixture
def files_stay(spark):
    """Range partitions are not put together, so that there is more than one file."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def scanned(df) -> int:
    """The rows that the file scans of a query gave out."""
    df.collect()

    def walk(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        return sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b) -> bool:
    return sorted(map(str, a.select(*PAPER_COLS).collect())) == sorted(map(str, b.select(*PAPER_COLS).collect()))


def test_point_reads_skip_row_groups_by_bloom_filter(spark, many, tmp_path, files_stay):
    root = str(tmp_path)
    tables.write_snapshot(many, root, "papers", options=SMALL)
    stored = tables.read_table(spark, root, "papers")
    wanted = many.where("id BETWEEN 699 AND 998 AND id % 3 = 0").select("doi")
    assert wanted.count() == 100
    found = lookup.point_lookup(stored, "doi", wanted)
    assert scanned(found) < 20_000 / 4 and found.count() == 100
    # more keys than a filter should hold: the same rows by a join
    joined = lookup.point_lookup(stored, "doi", wanted, most=99)
    assert "BroadcastHashJoin" in plan_of(joined) and same_rows(joined, found)
    assert lookup.point_lookup(stored, "doi", wanted.where("false")).count() == 0
    nulls = spark.createDataFrame([(None,), ("nowhere",)], "doi string")
    assert lookup.point_lookup(stored, "doi", nulls).count() == 0


def test_queues_prune_partitions_and_row_groups(spark, many, tmp_path, files_stay):
    queues.write_queues(many, str(tmp_path), bits=3, options=SMALL)
    stored = queues.read_queues(spark, str(tmp_path))
    assert same_rows(stored, many)
    for status in ("pending", "ready"):
        queue = listing.papers_in_status(stored, status)
        assert "PartitionFilters: [isnotnull(status" in plan_of(queue)
        assert scanned(queue) <= many.where(F.col("status") == status).count()
        assert [r.id for r in queue.collect()] == [r.id for r in listing.papers_in_status(many, status).collect()]
    years = lookup.papers_by_year(stored, 1991, 1993)
    venues = lookup.papers_by_venue(stored, [3, 4])
    both = lookup.papers_by_venue(years, [3, 4])
    assert scanned(years) < 20_000 * 0.6 and scanned(venues) < 20_000 * 0.6 and scanned(both) < 20_000 * 0.3
    assert same_rows(both, lookup.papers_by_venue(lookup.papers_by_year(many, 1991, 1993), [3, 4]))


def test_curve_interleaves_bits(spark):
    df = spark.range(16).select(F.col("id"), queues.curve({"a": F.expr("id div 4"), "b": F.expr("id % 4")}, 2).alias("z"))
    wanted = [int("".join(x + y for x, y in zip(f"{i // 4:02b}", f"{i % 4:02b}")), 2) for i in range(16)]
    assert [r.z for r in df.orderBy("id").collect()] == wanted


def test_queues_of_no_papers(spark, many, tmp_path):
    queues.write_queues(many.where("false"), str(tmp_path))
    assert (tmp_path / "papers_by_status").exists()


@pytest.fixture
def sort_merge(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_sides_stay_in_place(spark, many, tmp_path, sort_merge):
    root, draw = str(tmp_path), random.Random(1)
    edges = {(draw.randrange(300), 7 if i % 3 == 0 else draw.randrange(300)) for i in range(900)}
    citations = make(spark, "citations", *({"citing_paper_id": a, "cited_paper_id": b} for a, b in edges))
    bridge = make(
        spark, "paper_authors", *({"paper_id": a, "author_id": b, "position": 1 + (a + b) % 4} for a, b in edges)
    )
    papers = many.where("id < 300")
    buckets.write_buckets(papers, root, "papers", "id", 4)
    by_id = buckets.open_buckets(spark, root, "papers", "id").light
    for name, table, key, run, plain in (
        ("citations", citations, "cited_paper_id", graph.cited_by, graph.cited_by(citations, papers)),
        ("citations", citations, "citing_paper_id", graph.citing, graph.citing(citations, papers)),
    ):
        buckets.write_buckets(table, root, name, key, 4)
        found = run(buckets.open_buckets(spark, root, name, key), by_id)
        assert "Exchange" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    buckets.write_buckets(bridge, root, "paper_authors", "paper_id", 4)
    listed = nested.author_papers(buckets.open_buckets(spark, root, "paper_authors", "paper_id"), by_id)
    # one exchange, for the ranking by author
    assert plan_of(listed).count("Exchange hashpartitioning") == 1 and "hashpartitioning(author_id" in plan_of(listed)
    plain = nested.author_papers(bridge, papers)
    assert sorted(map(str, listed.collect())) == sorted(map(str, plain.select(*listed.columns).collect()))
    # another session has to declare the buckets itself
    buckets.forget_buckets(spark, root, "paper_authors", "paper_id")
    again = nested.author_papers(buckets.open_buckets(spark, root, "paper_authors", "paper_id"), by_id)
    assert plan_of(again).count("Exchange hashpartitioning") == 1 and again.count() == listed.count()


def test_heavy_keys_lie_apart_from_the_buckets(spark, many, tmp_path):
    root = str(tmp_path)
    rows = [(i, 5 if i % 3 == 0 else i % 40) for i in range(300)]
    edges = spark.createDataFrame([(*r, None) for r in rows] + [(1, None, None)], "citing_paper_id long, cited_paper_id long, created_at timestamp_ntz")
    buckets.write_buckets(edges, root, "citations", "cited_paper_id", 4, heavy_rows=50)
    stored = buckets.open_buckets(spark, root, "citations", "cited_paper_id")
    assert {r.cited_paper_id for r in stored.heavy.collect()} == {5, None}
    assert stored.light.where("cited_paper_id = 5").isEmpty()
    found, plain = graph.cited_by(stored, many), graph.cited_by(edges, many)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def modified(folder) -> dict[str, int]:
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_a_patch_rewrites_only_the_ranges_that_hold_its_ids(spark, many, tmp_path):
    root, papers = str(tmp_path), many.where("id < 5000")
    ranges.write_ranges(papers, root, "papers", 500)
    new = spark.createDataFrame([(i, i, f"new {i}") for i in [*range(600, 690), *range(4_000, 4_010), 9_999]], "seq int, id int, full_text string")
    folder, plans = tmp_path / "ranges" / "papers" / "rows", []
    before = modified(folder)

    def change(rows, few):
        after = changes.set_full_text(rows, few, NOW)
        plans.append(plan_of(after))
        return after

    assert ranges.patch(spark, root, "papers", new, change, "one") == [1, 8]
    after = modified(folder)
    untouched = {f for f in before if not f.startswith(("id_range=1/", "id_range=8/"))}
    assert all(after.get(f) == before[f] for f in untouched) and len(untouched) >= 8
    assert not {f for f in before if f not in untouched} & set(after)
    assert same_rows(ranges.read_ranges(spark, root, "papers"), changes.set_full_text(papers, new, NOW))
    # the wide rows are joined where they are read
    assert "BroadcastHashJoin" in plans[0] and "id_range" in plans[0]
    assert all("full_text" not in line for line in plans[0].splitlines() if "Exchange" in line)
    # a patch of this name is done
    assert ranges.patch(spark, root, "papers", new, lambda rows, few: rows.where("false"), "one") == [1, 8]
    assert ranges.read_ranges(spark, root, "papers").count() == 5_000


def test_a_patch_that_was_cut_off_is_finished(spark, many, tmp_path, monkeypatch):
    root, papers = str(tmp_path), many.where("id < 2000")
    ranges.write_ranges(papers, root, "papers", 500)
    gone = spark.range(500, 1_200).select("id")
    drop = lambda rows, few: rows.join(few, "id", "left_anti")
    monkeypatch.setattr(ranges, "finish_patches", lambda *a: [])
    ranges.patch(spark, root, "papers", gone, drop, "drop")
    assert ranges.read_ranges(spark, root, "papers").count() == 2_000
    monkeypatch.undo()
    assert ranges.finish_patches(spark, root, "papers") == ["drop"]
    assert ranges.finish_patches(spark, root, "papers") == []
    left = sorted(r.id for r in ranges.read_ranges(spark, root, "papers").select("id").collect())
    assert left == [*range(500), *range(1_200, 2_000)]
    nothing = spark.createDataFrame([], "id bigint")
    assert ranges.patch(spark, root, "papers", nothing, drop, "nothing") == []
    assert ranges.patch(spark, root, "papers", spark.range(7_000, 7_010), drop, "nowhere") == []


def test_merged_counts_equal_a_full_refresh(spark, many, tmp_path):
    root, draw = str(tmp_path), random.Random(4)
    papers = many.where("id < 400")
    edges = sorted({(draw.randrange(400), 7 if i % 3 == 0 else draw.randrange(400)) for i in range(900)})
    rows = lambda es: make(spark, "citations", *({"citing_paper_id": a, "cited_paper_id": b} for a, b in es))
    first, second = edges[:500], edges[500:]
    ranges.write_ranges(graph.refresh_citation_counts(papers, rows(first), NOW), root, "papers", 50)
    assert maintenance.merge_counts(spark, root, "a", rows(second), now=NOW) == list(range(8))
    counts = lambda df: {r.id: r.citation_count for r in df.select("id", "citation_count").collect()}
    full = counts(graph.refresh_citation_counts(papers, rows(edges), NOW))
    assert counts(ranges.read_ranges(spark, root, "papers")) == full
    # merged once, whatever comes again
    maintenance.merge_counts(spark, root, "a", rows(second), now=NOW)
    assert counts(ranges.read_ranges(spark, root, "papers")) == full
    # a cascade takes edges on both sides
    gone = spark.createDataFrame([(7,), (8,), (9,)], "id bigint")
    lost = graph.edges_of(rows(edges), gone)
    cited = {b for a, b in edges if a in (7, 8, 9) or b in (7, 8, 9)}
    assert maintenance.merge_counts(spark, root, "b", removed=lost, now=NOW) == sorted({b // 50 for b in cited})
    left = [e for e in edges if not {7, 8, 9} & set(e)]
    full = counts(graph.refresh_citation_counts(papers, rows(left), NOW))
    merged = counts(ranges.read_ranges(spark, root, "papers"))
    assert {i: n for i, n in merged.items() if i not in (7, 8, 9)} == {i: n for i, n in full.items() if i not in (7, 8, 9)}
    assert maintenance.merge_counts(spark, root, "c", lost, lost) == []
    with pytest.raises(ValueError):
        graph.edge_deltas()
