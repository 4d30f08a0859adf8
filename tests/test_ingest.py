from __future__ import annotations

from bibliospark.operators import ingest
from bibliospark.schemas import DEFAULT_VENUES, TABLES
from tests.samples import NOW, at, make, papers


def reasons(rejected, key="seq"):
    return {r[key]: (r.reason, r.key, r.reported_as) for r in rejected.collect()}


def test_venues(spark):
    stored = make(spark, "venues", {"id": 4, "name": "ISMIR", "type": "conference"})
    batch = spark.createDataFrame(
        [
            (1, "ISMIR", "conference", None),
            (2, "A", "journal", "https://a"),
            (3, "A", "journal", None),
            (4, "B", "magazine", None),
            (5, None, "journal", None),
            (6, "B", "preprint", None),
        ],
        "seq bigint, name string, type string, url string",
    )
    out = ingest.insert_venues(batch, stored, 9, NOW)
    rows = out.accepted.orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (10, "A", "journal", "https://a", NOW),
        (11, "B", "preprint", None, NOW),
    ]
    assert reasons(out.rejected) == {
        1: ("duplicate", "name", "duplicate"),
        3: ("duplicate", "name", "duplicate"),
        4: ("check", "type", "integrity"),
        5: ("not_null", "name", "integrity"),
    }


def test_venue_type_defaults_to_conference(spark):
    batch = spark.createDataFrame([(1, "X")], "seq bigint, name string")
    (row,) = ingest.insert_venues(batch, make(spark, "venues"), 0, NOW).accepted.collect()
    assert (row.id, row.type) == (1, "conference")


def test_seed_adds_only_missing_venues(spark):
    stored = make(spark, "venues", {"id": 3, "name": "arXiv", "type": "journal"})
    seeded = ingest.seed_venues(stored, 3, NOW)
    again = ingest.seed_venues(seeded, 9, NOW)
    for df in (seeded, again):
        rows = df.collect()
        assert {r.name for r in rows} == {n for n, _, _ in DEFAULT_VENUES}
        assert len(rows) == 7
        assert {r.type for r in rows if r.name == "arXiv"} == {"journal"}


def test_authors(spark):
    stored = make(spark, "authors", {"id": 1, "name": "Bo", "name_normalized": "bo"})
    batch = spark.createDataFrame(
        [(1, " Ann X ", None), (2, "ANN X", None), (3, "Bob", "bo"), (4, None, None)],
        "seq bigint, name string, name_normalized string",
    )
    out = ingest.insert_authors(batch, stored, 1, NOW)
    (row,) = out.accepted.collect()
    assert (row.id, row.name, row.name_normalized, row.affiliations) == (2, " Ann X ", "ann x", [])
    assert reasons(out.rejected) == {
        2: ("duplicate", "name_normalized", "duplicate"),
        3: ("duplicate", "name_normalized", "duplicate"),
        4: ("not_null", "name", "integrity"),
    }


def test_known_author_keeps_spelling_and_affiliations(spark):
    stored = make(
        spark, "authors", {"id": 5, "name": "Bo", "name_normalized": "bo", "affiliations": ["MIT"]}
    )
    mentions = spark.createDataFrame(
        [(1, 1, "BO", ["X"]), (1, 2, "New", ["Y"]), (2, 1, "new ", ["Z"])],
        "seq bigint, position int, name string, affiliations array<string>",
    )
    resolved = ingest.resolve_authors(mentions, stored, 5, NOW)
    assert {(r.seq, r.position): r.author_id for r in resolved.mentions.collect()} == {
        (1, 1): 5,
        (1, 2): 6,
        (2, 1): 6,
    }
    (row,) = resolved.added.collect()
    assert (row.id, row.name, row.affiliations) == (6, "New", ["Y"])


def test_papers_with_authors(spark):
    venues = make(spark, "venues", {"id": 1, "name": "V", "type": "journal"})
    batch = spark.createDataFrame(
        [(1, "one", 1, "a1"), (2, "two", 9, "a2"), (3, "three", None, "a1"), (4, "four", None, None)],
        "seq bigint, title string, venue_id bigint, arxiv_id string",
    )
    lists = spark.createDataFrame(
        [(1, 1, "First"), (1, 2, "Second"), (1, 3, "first "), (1, 4, None), (2, 1, "Lost"), (4, 1, "SECOND")],
        "seq bigint, position int, name string",
    )
    out = ingest.insert_papers(
        batch, make(spark, "papers"), make(spark, "authors"), venues, 0, 0, lists, NOW
    )
    rows = out.papers.orderBy("id").collect()
    assert [(r.id, r.title, r.status, r.citation_count) for r in rows] == [
        (1, "one", "pending", 0),
        (2, "four", "pending", 0),
    ]
    assert out.papers.schema.names == TABLES["papers"].names
    assert sorted((r.id, r.name) for r in out.authors.collect()) == [(1, "First"), (2, "Second")]
    assert sorted(map(tuple, out.paper_authors.collect())) == [(1, 1, 1), (1, 2, 2), (2, 2, 1)]
    assert reasons(out.rejected) == {
        2: ("foreign_key", "venue_id", "integrity"),
        3: ("duplicate", "arxiv_id", "duplicate"),
    }
    assert sorted((r.position, r.reason) for r in out.rejected_links.collect()) == [
        (3, "duplicate"),
        (4, "not_null"),
    ]


def test_papers_without_lists_and_null_values(spark):
    batch = spark.createDataFrame(
        [(1, "t", None, None), (2, "t", None, 7)],
        "seq bigint, title string, status string, citation_count bigint",
    )
    out = ingest.insert_papers(
        batch, make(spark, "papers"), make(spark, "authors"), make(spark, "venues"), 41, 0, None, NOW
    )
    rows = out.papers.orderBy("id").collect()
    assert [(r.id, r.status, r.citation_count) for r in rows] == [(42, None, None), (43, None, 7)]
    assert out.authors.count() == out.paper_authors.count() == out.rejected_links.count() == 0


def test_values_of_the_wrong_type_are_refused(spark):
    batch = spark.createDataFrame(
        [(1, "t", "2023"), (2, "t", "soon")], "seq bigint, title string, year string"
    )
    out = ingest.insert_papers(
        batch, make(spark, "papers"), make(spark, "authors"), make(spark, "venues"), 0, 0, None, NOW
    )
    assert [r.year for r in out.papers.collect()] == [2023]
    assert reasons(out.rejected) == {2: ("type", "year", "integrity")}


def test_citations_report_everything_as_duplicate(spark):
    batch = spark.createDataFrame(
        [(1, 1, 2), (2, 2, 1), (3, 2, 1), (4, 1, 9), (5, 1, 1), (6, None, 1)],
        "seq bigint, citing_paper_id bigint, cited_paper_id bigint",
    )
    stored = make(spark, "citations", {"citing_paper_id": 1, "cited_paper_id": 2})
    out = ingest.insert_citations(batch, stored, papers(spark, 1, 2), NOW)
    edges = sorted((r.citing_paper_id, r.cited_paper_id) for r in out.accepted.collect())
    assert edges == [(1, 1), (2, 1)]
    pair = "citing_paper_id,cited_paper_id"
    assert reasons(out.rejected) == {
        1: ("duplicate", pair, "duplicate"),
        3: ("duplicate", pair, "duplicate"),
        4: ("foreign_key", "cited_paper_id", "duplicate"),
        6: ("not_null", "citing_paper_id", "duplicate"),
    }


def test_queries_touch_their_conversations(spark):
    conversations = make(
        spark,
        "conversations",
        *({"id": i, "title": "c", "created_at": at(0), "updated_at": at(0)} for i in (1, 2)),
    )
    batch = spark.createDataFrame(
        [(1, 1, "q", "[1, 2, 3]"), (2, None, "q", ""), (3, 7, "q", None), (4, 1, None, None), (5, 1, "q", "[1")],
        "seq bigint, conversation_id bigint, query_text string, retrieved_ids string",
    )
    out = ingest.insert_queries(batch, conversations, 0, NOW)
    rows = out.accepted.orderBy("id").collect()
    assert [(r.id, r.conversation_id, r.retrieved_ids) for r in rows] == [(1, 1, [1, 2, 3]), (2, None, [])]
    assert {r.id: r.updated_at for r in out.conversations.collect()} == {1: NOW, 2: at(0)}
    assert {k: v[0] for k, v in reasons(out.rejected).items()} == {
        3: "foreign_key",
        4: "not_null",
        5: "malformed_json",
    }


def test_conversations_and_log(spark):
    opened = ingest.insert_conversations(
        spark.createDataFrame([(2, None), (1, "Test")], "seq bigint, title string"), 10, NOW
    )
    assert [(r.id, r.title) for r in opened.orderBy("id").collect()] == [(11, "Test"), (12, None)]
    batch = spark.createDataFrame(
        [(1, 1, "download", "success"), (2, 1, "print", "failed"), (3, 1, "embed", "maybe"), (4, None, "parse", "failed"), (5, 8, "parse", "failed")],
        "seq bigint, paper_id bigint, stage string, status string",
    )
    out = ingest.append_log(batch, papers(spark, 1), 0, NOW)
    assert [(r.id, r.stage) for r in out.accepted.orderBy("id").collect()] == [(1, "download"), (2, "parse")]
    assert {k: v[:2] for k, v in reasons(out.rejected).items()} == {
        2: ("check", "stage"),
        3: ("check", "status"),
        5: ("foreign_key", "paper_id"),
    }


def test_every_row_is_accepted_or_refused(spark):
    rows = [(None, "A", "journal", 7), (1, "B", "journal", 7), (2, "C", "journal", 7), (2, "D", "journal", 8)]
    batch = spark.createDataFrame(rows, "seq bigint, name string, type string, id bigint")
    out = ingest.insert_venues(batch, make(spark, "venues"), 0, NOW)
    assert [(r.id, r.name) for r in out.accepted.collect()] == [(1, "B")]
    assert sorted(r.reason for r in out.rejected.collect()) == ["order_null", "order_repeated", "order_repeated"]


def test_edge_without_an_order_is_refused_only(spark):
    batch = spark.createDataFrame([(None, 1, 9), (1, 1, 2)], "seq bigint, citing_paper_id bigint, cited_paper_id bigint")
    out = ingest.insert_citations(batch, make(spark, "citations"), papers(spark, 1, 2), NOW)
    assert [(r.citing_paper_id, r.cited_paper_id) for r in out.accepted.collect()] == [(1, 2)]
    assert [r.reason for r in out.rejected.collect()] == ["order_null"]


def test_author_lists_with_missing_and_repeated_places(spark):
    batch = spark.createDataFrame([(1, "t")], "seq bigint, title string")
    lists = spark.createDataFrame(
        [(1, 1, "Ann"), (1, 1, "Ann"), (1, None, "Bob"), (1, 2, "Cy")], "seq bigint, position int, name string"
    )
    out = ingest.insert_papers(
        batch, papers(spark), make(spark, "authors"), make(spark, "venues"), 0, 0, lists, NOW
    )
    assert sorted((r.author_id, r.position) for r in out.paper_authors.collect()) == [(1, 1), (2, 2)]
    assert sorted((r.reason, r.key) for r in out.rejected_links.collect()) == [
        ("duplicate", "paper_id,author_id"),
        ("not_null", "position"),
    ]


def test_lists_of_accepted_papers_are_joined_and_their_names_normalised_once(spark, monkeypatch):
    batch = spark.createDataFrame([(1, "one", "a"), (2, "two", "a")], "seq bigint, title string, arxiv_id string")
    lists = spark.createDataFrame(
        [(1, 1, " Ann "), (1, 2, "Bo"), (2, 1, "Cy"), (1, 3, "ann")], "seq bigint, position int, name string"
    )
    kept, keep = {}, ingest.keep
    monkeypatch.setattr(ingest, "keep", lambda df, label: kept.setdefault(label, keep(df, label)))
    out = ingest.insert_papers(
        batch, make(spark, "papers"), make(spark, "authors"), make(spark, "venues"), 0, 0, lists, NOW
    )
    assert sorted(map(tuple, out.paper_authors.collect())) == [(1, 1, 1), (1, 2, 2)]
    listed = kept["listed-authors"].orderBy("position").collect()
    assert [(r.paper_id, r.name_normalized) for r in listed] == [(1, "ann"), (1, "bo"), (1, "ann")]
