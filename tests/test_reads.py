from __future__ import annotations

import pytest

from bibliospark.operators import graph, listing, lookup, nested
from tests.samples import at, make, papers


@pytest.fixture(scope="module")
def library(spark):
    table = papers(spark, 1, 2, year=2023, status="pending", created_at=at(1), venue_id=1, doi="d")
    table = table.unionByName(papers(spark, 3, year=2024, status="pending", created_at=at(0), arxiv_id="x"))
    table = table.unionByName(papers(spark, 4, status="ready", embedding_model="m", created_at=at(5)))
    authors = make(
        spark, "authors", *({"id": i, "name": f"N{i}", "name_normalized": f"n{i}"} for i in (1, 2, 3))
    )
    links = [(1, 3, 1), (1, 1, 2), (1, 2, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1)]
    bridge = make(
        spark, "paper_authors", *({"paper_id": p, "author_id": a, "position": n} for p, a, n in links)
    )
    edges = make(
        spark, "citations", *({"citing_paper_id": a, "cited_paper_id": b} for a, b in [(2, 1), (3, 1), (3, 2)])
    )
    return table, authors, bridge, edges


def ids(df):
    return [r.id for r in df.collect()]


def test_lookups(spark, library):
    table = library[0]
    assert ids(lookup.papers_by_id(table, 1)) == [1]
    assert ids(lookup.papers_by_id(table, 99999)) == []
    assert sorted(ids(lookup.papers_by_id(table, [1, 3, 77]))) == [1, 3]
    keys = spark.createDataFrame([("x",), (None,), ("X",)], "anything string")
    assert ids(lookup.papers_by_arxiv_id(table, keys)) == [3]
    assert ids(lookup.papers_by_arxiv_id(table, "X")) == []
    assert sorted(ids(lookup.papers_by_doi(table, "d"))) == [1, 2]
    wanted = spark.createDataFrame([(1,), (1,), (None,)], "v int")
    assert sorted(ids(lookup.papers_by_venue(table, wanted))) == [1, 2]
    assert ids(lookup.papers_by_year(table, 2024)) == [3]
    assert sorted(ids(lookup.papers_by_year(table, 2023, 2024))) == [1, 2, 3]
    assert ids(lookup.embedded_papers(table)) == [4]


def test_filters_reach_the_scan(spark, library, tmp_path):
    library[0].write.parquet(f"{tmp_path}/papers")
    table = spark.read.parquet(f"{tmp_path}/papers")
    plan = lookup.papers_by_id(table, [1, 2]).select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [1,2])]" in plan
    assert "ReadSchema: struct<id:bigint,title:string>" in plan


def test_work_queues(library):
    table = library[0]
    assert ids(listing.papers_in_status(table, "pending")) == [3, 1, 2]
    assert ids(listing.papers_in_status(table, "pending", 2)) == [3, 1]
    assert ids(listing.papers_in_status(table, "pending", 0)) == []
    assert ids(listing.papers_in_status(table, "pending", -1)) == [3, 1, 2]
    ranks = {(r.status, r.rank): r.id for r in listing.oldest_per_status(table, 2).collect()}
    assert ranks == {("pending", 1): 3, ("pending", 2): 1, ("ready", 1): 4}
    plan = listing.oldest_per_status(table, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert listing.oldest_per_status(table, -1).count() == 4


def test_venues_and_conversations(spark):
    venues = make(spark, "venues", *({"id": i, "name": n, "type": "journal"} for i, n in enumerate(["b", "B", "A"])))
    assert [r.name for r in listing.list_venues(venues).collect()] == ["A", "B", "b"]
    talks = make(
        spark, "conversations", *({"id": i, "updated_at": at(m)} for i, m in [(1, 3), (2, 5), (3, 5)]), {"id": 4}
    )
    assert ids(listing.recent_conversations(talks)) == [2, 3, 1, 4]
    assert ids(listing.recent_conversations(talks, 1)) == [2]


@pytest.mark.parametrize("min_rows", [None, 2])
def test_entries_in_time_order(spark, min_rows):
    log = make(
        spark,
        "processing_log",
        *(
            {"id": i, "paper_id": p, "stage": s, "status": "success", "created_at": at(m)}
            for i, p, s, m in [(1, 1, "extract", 5), (2, 1, "parse", 5), (3, 1, "download", 1), (4, 2, "embed", 0)]
        ),
        {"id": 5, "stage": "embed", "status": "failed"},
    )
    rows = listing.paper_log(log, None, min_rows).collect()
    assert sorted((r.paper_id, r.rank, r.stage) for r in rows) == [
        (1, 1, "download"),
        (1, 2, "extract"),
        (1, 3, "parse"),
        (2, 1, "embed"),
    ]
    assert [r.id for r in listing.paper_log(log, 2, min_rows).collect()] == [4]


@pytest.mark.parametrize("min_rows", [None, 2])
def test_authors_and_papers(library, min_rows):
    table, authors, bridge, _ = library
    listed = nested.paper_authors(bridge, authors, min_rows).where("paper_id = 1").collect()
    assert sorted((r.rank, r.author_id) for r in listed) == [(1, 3), (2, 1), (3, 2)]
    rows = nested.author_papers(bridge, table, min_rows).where("author_id = 1").collect()
    assert sorted((r.rank, r.paper_id) for r in rows) == [(1, 3), (2, 1), (3, 2), (4, 4)]


@pytest.mark.parametrize("min_rows,page_size", [(None, 1000), (None, 2), (2, 2), (None, None)])
def test_nested_authors_come_in_pages(spark, library, min_rows, page_size):
    table, authors, bridge, _ = library
    table = table.unionByName(papers(spark, 9))
    rows = nested.papers_with_authors(table, bridge, authors, page_size, min_rows).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.page)):
        assert len(r.authors) <= (page_size or 1000)
        got.setdefault(r.id, []).extend(a.author_id for a in r.authors)
    assert got == {1: [3, 1, 2], 2: [1], 3: [1], 4: [1], 9: []}
    if page_size in (1000, None):
        assert len(rows) == 5


def test_nested_queries_and_venue(spark, library):
    talks = make(spark, "conversations", {"id": 1, "title": "Test"}, {"id": 2})
    queries = make(
        spark,
        "queries",
        *({"id": i, "conversation_id": 1, "query_text": f"q{i}", "created_at": at(9 - i)} for i in (1, 2)),
    )
    rows = {r.id: r for r in nested.conversations_with_queries(talks, queries).collect()}
    assert [q.query_text for q in rows[1].queries] == ["q2", "q1"]
    assert rows[2].queries == []
    venues = make(spark, "venues", {"id": 1, "name": "V", "type": "journal"})
    found = {r.id: r.venue for r in nested.papers_with_venue(library[0], venues).collect()}
    assert found[1].name == "V" and found[3] is None


def test_citation_graph(spark, library):
    table, _, _, edges = library
    assert ids(graph.cited_by(edges, table, 2)) == [1]
    assert sorted(ids(graph.citing(edges, table, 1))) == [2, 3]
    some = spark.createDataFrame([(1,), (2,)], "k bigint")
    got = graph.citing(edges, table, some).collect()
    assert sorted((r.cited_paper_id, r.id) for r in got) == [(1, 2), (1, 3), (2, 3)]
    counted = graph.refresh_citation_counts(table, edges)
    assert {r.id: r.citation_count for r in counted.collect()} == {1: 2, 2: 1, 3: 0, 4: 0}
