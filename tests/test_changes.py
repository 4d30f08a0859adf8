from __future__ import annotations

from bibliospark.operators import changes, graph
from bibliospark.operators.ids import assign_ids
from tests.samples import NOW, at, make, papers


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def test_last_change_of_an_id_stays_and_unknown_ids_do_nothing(spark):
    authors = make(
        spark,
        "authors",
        {"id": 1, "name": "A", "name_normalized": "a", "affiliations": ["MIT"]},
        {"id": 2, "name": "B", "name_normalized": "b", "affiliations": ["MIT"]},
    )
    asked = spark.createDataFrame(
        [(1, 1, ["X"]), (3, 1, ["Lab A", "Lab B"]), (2, 1, ["Y"]), (4, 99, ["Z"])],
        "seq bigint, id bigint, affiliations array<string>",
    )
    after = changes.set_affiliations(authors, asked)
    assert by_id(after, "affiliations") == {1: (["Lab A", "Lab B"],), 2: (["MIT"],)}


def test_status(spark):
    table = papers(spark, 1, 2, 3, status="pending", updated_at=at(0))
    asked = spark.createDataFrame(
        [(1, 1, "downloaded"), (2, 1, "lost"), (3, 2, None), (4, 9, "lost")],
        "seq bigint, id bigint, status string",
    )
    out = changes.set_status(table, asked, NOW)
    assert by_id(out.accepted, "status", "updated_at") == {
        1: ("downloaded", NOW),
        2: (None, NOW),
        3: ("pending", at(0)),
    }
    assert [(r.seq, r.reason) for r in out.rejected.collect()] == [(2, "check")]


def test_text_and_embedding(spark):
    table = papers(spark, 1, 2, status="pending", updated_at=at(0))
    texts = spark.createDataFrame([(1, 1, "whole text")], "seq bigint, id bigint, full_text string")
    after = changes.set_full_text(table, texts, NOW)
    assert by_id(after, "full_text", "status", "updated_at") == {
        1: ("whole text", "extracted", NOW),
        2: (None, "pending", at(0)),
    }
    models = spark.createDataFrame([(1, 2, "m")], "seq bigint, id bigint, embedding_model string")
    ready = changes.mark_embedded(after, models, NOW)
    assert by_id(ready, "embedding_model", "embedded_at", "status") == {
        1: (None, None, "extracted"),
        2: ("m", NOW, "ready"),
    }
    assert ready.columns == table.columns


def test_touch(spark):
    table = papers(spark, 1, 2, updated_at=at(0))
    ids = spark.createDataFrame([(1,), (1,)], "id bigint")
    assert by_id(changes.touch_papers(table, ids, NOW), "updated_at") == {1: (NOW,), 2: (at(0),)}


def test_delete_papers_cascades(spark):
    table = papers(spark, 1, 2, 3, citation_count=2)
    links = make(spark, "paper_authors", *({"paper_id": p, "author_id": 1, "position": 1} for p in (1, 2)))
    edges = make(
        spark,
        "citations",
        *({"citing_paper_id": a, "cited_paper_id": b} for a, b in [(1, 2), (2, 3), (3, 1), (3, 2), (2, 2)]),
    )
    log = make(
        spark,
        "processing_log",
        *({"id": i, "paper_id": p, "stage": "parse", "status": "failed"} for i, p in enumerate([1, 2, None])),
    )
    ids = spark.createDataFrame([(1,), (1,), (77,), (None,)], "id bigint")
    out = changes.delete_papers(ids, table, links, edges, log)
    assert [r.id for r in out.deleted.collect()] == [1]
    assert by_id(out.tables["papers"], "citation_count") == {2: (2,), 3: (2,)}
    assert [r.paper_id for r in out.tables["paper_authors"].collect()] == [2]
    kept = out.tables["citations"]
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(2, 2), (2, 3), (3, 2)]
    assert sorted(r.id for r in out.tables["processing_log"].collect()) == [1, 2]
    counts = graph.refresh_citation_counts(out.tables["papers"], kept, NOW)
    assert by_id(counts, "citation_count", "updated_at") == {2: (2, NOW), 3: (1, NOW)}


def test_id_of_a_deleted_paper_does_not_come_back(spark):
    rows = spark.createDataFrame([(1,), (2,)], "seq bigint")
    first = assign_ids(rows, ["seq"], 0)
    mark = max(r.id for r in first.collect())
    remaining = first.where("id < 2")
    second = assign_ids(rows.where("seq = 1"), ["seq"], mark)
    assert [r.id for r in remaining.unionByName(second).collect()] == [1, 3]


def test_delete_conversations_and_authors(spark):
    conversations = make(spark, "conversations", {"id": 1}, {"id": 2})
    queries = make(
        spark,
        "queries",
        *({"id": i, "conversation_id": c, "query_text": "q"} for i, c in [(1, 1), (2, 2), (3, None)]),
    )
    ids = spark.createDataFrame([(1,)], "id bigint")
    out = changes.delete_conversations(ids, conversations, queries)
    assert sorted(r.id for r in out.tables["queries"].collect()) == [2, 3]
    assert [r.id for r in out.tables["conversations"].collect()] == [2]
    authors = make(spark, "authors", *({"id": i, "name": "n", "name_normalized": str(i)} for i in (1, 2)))
    links = make(spark, "paper_authors", *({"paper_id": 5, "author_id": a, "position": a} for a in (1, 2)))
    out = changes.delete_authors(ids, authors, links)
    assert [r.author_id for r in out.tables["paper_authors"].collect()] == [2]
    assert [r.id for r in out.deleted.collect()] == [1]


def test_venue_in_use_is_not_deleted(spark):
    venues = make(spark, "venues", *({"id": i, "name": str(i), "type": "journal"} for i in (1, 2, 3)))
    table = papers(spark, 1, venue_id=1).unionByName(papers(spark, 2))
    out = changes.delete_venues(spark.createDataFrame([(1,), (2,), (8,)], "id bigint"), venues, table)
    assert sorted(r.id for r in out.venues.collect()) == [1, 3]
    assert [r.id for r in out.deleted.collect()] == [2]
    assert [(r.id, r.reason) for r in out.rejected.collect()] == [(1, "foreign_key")]


def test_counts_without_edges_are_zero(spark):
    counted = graph.refresh_citation_counts(papers(spark, 1, 2, citation_count=9), make(spark, "citations"), NOW)
    assert by_id(counted, "citation_count", "updated_at") == {1: (0, NOW), 2: (0, NOW)}


def test_touch_never_moves_back_and_changes_without_order_count(spark):
    talks = make(spark, "conversations", {"id": 1, "updated_at": at(30)}, {"id": 2, "updated_at": at(1)})
    asked = make(
        spark, "queries", *({"id": i, "conversation_id": i, "query_text": "q", "created_at": at(9)} for i in (1, 2))
    )
    assert by_id(changes.touch_conversations(talks, asked), "updated_at") == {1: (at(30),), 2: (at(9),)}
    new = spark.createDataFrame([(None, 1, "failed")], "seq bigint, id bigint, status string")
    after = changes.set_status(papers(spark, 1, status="pending"), new, NOW).accepted
    assert by_id(after, "status") == {1: ("failed",)}
