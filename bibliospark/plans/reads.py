"""Scans, lookups, lists, joins and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bibliospark.functions import scalars
from bibliospark.operators import graph, listing, lookup, maintenance, nested, retrieval
from bibliospark.operators.ids import assign_ids
from bibliospark.plans.base import NOW, NOW_SQL, query
from bibliospark.schemas import DEFAULT_VENUES, PAPER_COLS
from bibliospark.sources import driver_tables as shape
from bibliospark.sources import buckets, queues, tables
from bibliospark.sources.durable import new_path

ALL_PAPER = ", ".join(PAPER_COLS)
BRIEF = ["id", "title", "venue_id", "year", "status"]
SEEDS = ", ".join(f"({i}, '{n}', '{t}', '{u}')" for i, (n, t, u) in enumerate(DEFAULT_VENUES))


# --- scans and sinks -------------------------------------------------------


@query("scan_papers", f"SELECT {ALL_PAPER} FROM c_papers")
def scan_papers(spark, folder):
    return scalars.paper_columns(shape.papers(spark, folder))


@query("snapshot_papers", f"SELECT {ALL_PAPER} FROM c_papers")
def snapshot_papers(spark, folder):
    """Write a snapshot of the papers and read it back."""
    root = new_path(spark, "snapshot")
    tables.write_snapshot(shape.papers(spark, folder), root, "papers")
    return tables.read_table(spark, root, "papers")


@query(
    "declared_and_seeded_venues",
    "SELECT row_number() OVER (ORDER BY seq) AS id, name, type, url FROM c_seeds",
    {"c_seeds": f"SELECT * FROM (VALUES {SEEDS}) AS v(seq, name, type, url)"},
)
def declared_and_seeded_venues(spark, folder):
    """Declare all tables in a new place and seed the venues, twice: the second run adds none."""
    roots = [new_path(spark, "declared") for _ in range(3)]
    added = [maintenance.initialise(spark, a, b) for a, b in zip(roots, roots[1:])]
    if added[1]:
        raise AssertionError(f"the second run added {added[1]} venues")
    return tables.read_table(spark, roots[2], "venues").drop("created_at")


@query(
    "declared_beside_given_venues",
    """SELECT id, name, type, url FROM c_venues
       UNION ALL
       SELECT (SELECT max(id) FROM c_venues) + row_number() OVER (ORDER BY seq), name, type, url
       FROM c_seeds WHERE name NOT IN (SELECT name FROM c_venues)""",
    {"c_seeds": f"SELECT * FROM (VALUES {SEEDS}) AS v(seq, name, type, url)"},
)
def declared_beside_given_venues(spark, folder):
    """Declare all tables where the given venues lie already: their rows stay and the missing defaults join them."""
    root, after = new_path(spark, "given"), new_path(spark, "declared")
    tables.write_snapshot(shape.venues(spark, folder), root, "venues")
    maintenance.initialise(spark, root, after)
    return tables.read_table(spark, after, "venues").drop("created_at")


@query(
    "refresh_counts_of_snapshot",
    """SELECT p.id, coalesce(n, 0) AS citation_count
       FROM c_papers p LEFT JOIN (SELECT cited_paper_id, count(*) AS n FROM c_citations GROUP BY 1) e
         ON e.cited_paper_id = p.id""",
)
def refresh_counts_of_snapshot(spark, folder):
    """The maintenance job, from a stored snapshot to the next."""
    root, after = new_path(spark, "snapshot"), new_path(spark, "refreshed")
    tables.write_snapshot(shape.papers(spark, folder), root, "papers")
    tables.write_snapshot(shape.citations(spark, folder), root, "citations")
    maintenance.refresh_counts(spark, root, after)
    return tables.read_table(spark, after, "papers").select("id", "citation_count")


@query(
    "ids_after_a_delete",
    "SELECT o_orderkey AS seq, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders",
)
def ids_after_a_delete(spark, folder):
    """All papers go, and new ones get ids above those that are gone."""
    first, second = new_path(spark, "snapshot"), new_path(spark, "emptied")
    papers = shape.papers(spark, folder)
    tables.write_snapshot(papers, first, "papers")
    left = tables.read_table(spark, first, "papers").join(papers.select("id"), "id", "left_anti")
    tables.write_snapshot(left, second, "papers", tables.high_water(spark, first, "papers"))
    batch = papers.select(F.col("id").alias("seq"))
    return assign_ids(batch, ["seq"], tables.high_water(spark, second, "papers")).select("seq", "id")


# --- scalar functions ------------------------------------------------------


@query(
    "normalize_names",
    """SELECT o_orderkey, trim(lower(chr(9) || ' ' || o_orderpriority || chr(10)), ' ' || chr(9) || chr(10)) AS name_normalized
       FROM orders""",
)
def normalize_names(spark, folder):
    name = F.concat(F.lit("\t "), F.col("o_orderpriority"), F.lit("\n"))
    return shape.table(spark, folder, "orders").select(
        "o_orderkey", scalars.name_key(name).alias("name_normalized")
    )


@query(
    "array_to_json",
    "SELECT event_id, '[' || event_id || ',' || user_id || ']' AS ids_json FROM events",
)
def array_to_json(spark, folder):
    return shape.table(spark, folder, "events").select(
        "event_id", scalars.array_to_json(F.array("event_id", "user_id")).alias("ids_json")
    )


@query(
    "json_to_array",
    """SELECT event_id, len(ids)::INTEGER AS n, ids[1] AS first_id, ids[2] AS second_id, bad
       FROM (SELECT event_id,
                    CASE WHEN text IS NULL OR text = '' THEN []::BIGINT[]
                         ELSE TRY_CAST(TRY_CAST(text AS JSON) AS BIGINT[]) END AS ids,
                    coalesce(text LIKE '%;' OR (text LIKE '[%' AND event_id % 7 < 6), false) AS bad
             FROM (SELECT event_id,
                          CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN ''
                               WHEN 'error' THEN '[' || event_id || ';'
                               ELSE '[' || event_id || ', ' || user_id || ']' || CASE event_id % 7 WHEN 0 THEN ' junk' WHEN 1 THEN ' [2]'
                                    WHEN 2 THEN ',"w":[1]' WHEN 3 THEN '}' WHEN 4 THEN '} junk' WHEN 5 THEN '}{"x":1}'
                                    ELSE '' END END AS text
                   FROM events))""",
)
def json_to_array(spark, folder):
    kind, rest = F.col("event_type"), F.col("event_id") % 7
    after = F.when(rest == 0, " junk").when(rest == 1, " [2]").when(rest == 2, ',"w":[1]')
    after = after.when(rest == 3, "}").when(rest == 4, "} junk").when(rest == 5, '}{"x":1}').otherwise("")
    text = (
        F.when(kind == "view", F.lit(None))
        .when(kind == "click", "")
        .when(kind == "error", F.concat(F.lit("["), F.col("event_id"), F.lit(";")))
        .otherwise(F.concat(F.lit("["), F.col("event_id"), F.lit(", "), F.col("user_id"), F.lit("]"), after))
    )
    events = shape.table(spark, folder, "events").select("event_id", text.alias("text"))
    ids = scalars.json_to_array(F.col("text"), "bigint")
    return events.select(
        "event_id",
        ids.alias("ids"),
        scalars.is_malformed_json(F.col("text"), "bigint").alias("bad"),
    ).select(
        "event_id",
        F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"),
        F.get("ids", F.lit(0)).alias("first_id"),
        F.get("ids", F.lit(1)).alias("second_id"),
        "bad",
    )


@query(
    "element_positions",
    """SELECT id, position::INTEGER AS position, retrieved_id
       FROM (SELECT id, unnest(retrieved_ids) AS retrieved_id, generate_subscripts(retrieved_ids, 1) AS position
             FROM c_queries)""",
)
def element_positions(spark, folder):
    lists = shape.queries(spark, folder).select("id", "retrieved_ids")
    return scalars.element_positions(lists, "retrieved_ids", "retrieved_id")


# --- keyed lookups ---------------------------------------------------------


@query(
    "venues_by_id",
    "SELECT * FROM c_venues WHERE id IN (SELECT p_size FROM part)",
)
def venues_by_id(spark, folder):
    keys = shape.table(spark, folder, "part").select("p_size")
    return lookup.venues_by_id(shape.venues(spark, folder), keys).drop("created_at")


@query(
    "venues_by_name",
    "SELECT * FROM c_venues WHERE name IN (SELECT 'NATION_' || p_size FROM part)",
)
def venues_by_name(spark, folder):
    keys = shape.table(spark, folder, "part").select(F.concat(F.lit("NATION_"), F.col("p_size")))
    return lookup.venues_by_name(shape.venues(spark, folder), keys).drop("created_at")


AUTHOR_SQL = "id, name, name_normalized, affiliations[1] AS affiliation"


def _flat_author(df):
    return df.select("id", "name", "name_normalized", F.get("affiliations", F.lit(0)).alias("affiliation"))


@query(
    "authors_by_id",
    f"SELECT {AUTHOR_SQL} FROM c_authors WHERE id IN (SELECT l_suppkey * 2 FROM lineitem)",
)
def authors_by_id(spark, folder):
    keys = shape.table(spark, folder, "lineitem").select(F.col("l_suppkey") * 2)
    return _flat_author(lookup.authors_by_id(shape.authors(spark, folder), keys))


@query(
    "authors_by_name",
    f"""SELECT {AUTHOR_SQL} FROM c_authors
        WHERE name_normalized IN (SELECT replace(lower(c_name), 'customer', 'supplier') FROM customer)""",
)
def authors_by_name(spark, folder):
    keys = shape.table(spark, folder, "customer").select(
        F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier"))
    )
    return _flat_author(lookup.authors_by_name(shape.authors(spark, folder), keys))


@query("papers_by_id", f"SELECT {ALL_PAPER} FROM c_papers WHERE id IN (SELECT doc_id * 2 FROM documents)")
def papers_by_id(spark, folder):
    keys = shape.table(spark, folder, "documents").select(F.col("doc_id") * 2)
    return lookup.papers_by_id(shape.papers(spark, folder), keys)


@query(
    "papers_by_arxiv_id",
    f"SELECT {ALL_PAPER} FROM c_papers WHERE arxiv_id IN (SELECT 'arx.' || event_id FROM events)",
)
def papers_by_arxiv_id(spark, folder):
    keys = shape.table(spark, folder, "events").select(F.concat(F.lit("arx."), F.col("event_id")))
    return lookup.papers_by_arxiv_id(shape.papers(spark, folder), keys)


@query(
    "papers_by_doi",
    f"SELECT {ALL_PAPER} FROM c_papers WHERE doi IN (SELECT '10/' || p_partkey FROM part)",
)
def papers_by_doi(spark, folder):
    keys = shape.table(spark, folder, "part").select(F.concat(F.lit("10/"), F.col("p_partkey")))
    return lookup.papers_by_doi(shape.papers(spark, folder), keys)


@query(
    "papers_by_doi_of_snapshot",
    f"SELECT {ALL_PAPER} FROM c_papers WHERE doi IN (SELECT '10/' || n_nationkey * 7 FROM nation)",
)
def papers_by_doi_of_snapshot(spark, folder):
    """Few keys against a stored snapshot, as a filter that bloom filters answer."""
    root = new_path(spark, "snapshot")
    tables.write_snapshot(shape.papers(spark, folder), root, "papers")
    keys = shape.table(spark, folder, "nation").select(F.concat(F.lit("10/"), F.col("n_nationkey") * 7))
    return lookup.point_lookup(tables.read_table(spark, root, "papers"), "doi", keys)


@query(
    "conversations_by_id",
    "SELECT * FROM c_conversations WHERE id IN (SELECT s_suppkey * 2 FROM supplier)",
)
def conversations_by_id(spark, folder):
    keys = shape.table(spark, folder, "supplier").select(F.col("s_suppkey") * 2)
    return lookup.conversations_by_id(shape.conversations(spark, folder), keys)


@query(
    "queries_by_id",
    """SELECT id, conversation_id, query_text, response_text, retrieved_ids[2] AS second_id, model_used, latency_ms, created_at
       FROM c_queries WHERE id IN (SELECT doc_id * 1000 + 1 FROM documents)""",
)
def queries_by_id(spark, folder):
    keys = shape.table(spark, folder, "documents").select(F.col("doc_id") * 1000 + 1)
    found = lookup.queries_by_id(shape.queries(spark, folder), keys)
    return found.withColumn("second_id", F.get("retrieved_ids", F.lit(1))).drop("retrieved_ids")


@query(
    "papers_by_venue",
    f"""SELECT {ALL_PAPER} FROM c_papers
        WHERE venue_id IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
)
def papers_by_venue(spark, folder):
    asia = shape.table(spark, folder, "region").where("r_name = 'ASIA'")
    nation = shape.table(spark, folder, "nation")
    keys = nation.join(asia, nation.n_regionkey == asia.r_regionkey).select("n_nationkey")
    return lookup.papers_by_venue(shape.papers(spark, folder), keys)


@query("papers_by_year", f"SELECT {ALL_PAPER} FROM c_papers WHERE year BETWEEN 1996 AND 1998")
def papers_by_year(spark, folder):
    return lookup.papers_by_year(shape.papers(spark, folder), 1996, 1998)


@query("embedded_papers", f"SELECT {ALL_PAPER} FROM c_papers WHERE embedding_model IS NOT NULL")
def embedded_papers(spark, folder):
    return lookup.embedded_papers(shape.papers(spark, folder))


# --- sorted lists ----------------------------------------------------------


def _place(*order):
    """The place in a list that a limit has bounded, to expose its order to the check."""
    return F.row_number().over(Window.orderBy(*order)).cast("bigint")


@query("list_venues", "SELECT id, name, type, url FROM c_venues ORDER BY name")
def list_venues(spark, folder):
    return listing.list_venues(shape.venues(spark, folder)).drop("created_at")


@query(
    "papers_in_status",
    f"""SELECT {ALL_PAPER}, row_number() OVER (ORDER BY created_at, id) AS rank
        FROM c_papers WHERE status = 'pending' ORDER BY created_at, id LIMIT 100""",
)
def papers_in_status(spark, folder):
    queue = listing.papers_in_status(shape.papers(spark, folder), "pending")
    return queue.withColumn("rank", _place(F.col("created_at").asc(), F.col("id").asc()))


def _queues(spark, folder):
    root = new_path(spark, "queues")
    queues.write_queues(shape.papers(spark, folder), root)
    return queues.read_queues(spark, root)


@query(
    "queue_of_partitions",
    f"""SELECT {ALL_PAPER}, row_number() OVER (ORDER BY created_at, id) AS rank
        FROM c_papers WHERE status = 'pending' ORDER BY created_at, id LIMIT 100""",
)
def queue_of_partitions(spark, folder):
    """The work queue from the layout by status."""
    queue = listing.papers_in_status(_queues(spark, folder), "pending")
    return queue.withColumn("rank", _place(F.col("created_at").asc(), F.col("id").asc()))


@query(
    "papers_on_a_curve",
    f"""SELECT {ALL_PAPER} FROM c_papers
        WHERE year BETWEEN 1996 AND 1998 AND venue_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
)
def papers_on_a_curve(spark, folder):
    """Papers of some venues and years from the layout by status, venue and year."""
    asia = shape.table(spark, folder, "nation").where("n_regionkey = 2").select("n_nationkey")
    return lookup.point_lookup(lookup.papers_by_year(_queues(spark, folder), 1996, 1998), "venue_id", asia)


@query(
    "oldest_per_status",
    """SELECT id, title, venue_id, year, status, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS rank
       FROM c_papers QUALIFY rank <= 100""",
)
def oldest_per_status(spark, folder):
    return listing.oldest_per_status(shape.papers(spark, folder)).select(*BRIEF, "rank")


@query(
    "all_papers_per_status",
    """SELECT id, title, venue_id, year, status, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS rank
       FROM c_papers""",
)
def all_papers_per_status(spark, folder):
    """The whole queue of every status: a negative limit is none."""
    return listing.oldest_per_status(shape.papers(spark, folder), -1).select(*BRIEF, "rank")


@query(
    "recent_conversations",
    """SELECT *, row_number() OVER (ORDER BY updated_at DESC, id) AS rank
       FROM c_conversations ORDER BY updated_at DESC, id LIMIT 50""",
)
def recent_conversations(spark, folder):
    recent = listing.recent_conversations(shape.conversations(spark, folder))
    return recent.withColumn("rank", _place(F.col("updated_at").desc(), F.col("id").asc()))


@query(
    "conversation_queries",
    """SELECT id, conversation_id, query_text, response_text, created_at,
              row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS rank
       FROM c_queries""",
)
def conversation_queries(spark, folder):
    listed = listing.conversation_queries(shape.queries(spark, folder))
    return listed.select("id", "conversation_id", "query_text", "response_text", "created_at", "rank")


@query(
    "paper_log",
    "SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at, id) AS rank FROM c_log",
)
def paper_log(spark, folder):
    return listing.paper_log(shape.processing_log(spark, folder))


@query(
    "paper_log_of_some",
    """SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at, id) AS rank
       FROM c_log WHERE paper_id IN (SELECT s_suppkey FROM supplier)""",
)
def paper_log_of_some(spark, folder):
    keys = shape.table(spark, folder, "supplier").select("s_suppkey")
    return listing.paper_log(shape.processing_log(spark, folder), keys)


# --- joins -----------------------------------------------------------------


@query(
    "paper_authors",
    """SELECT paper_id, author_id, position, name, name_normalized,
              row_number() OVER (PARTITION BY paper_id ORDER BY position, author_id) AS rank
       FROM c_paper_authors JOIN c_authors ON author_id = id""",
)
def paper_authors(spark, folder):
    listed = nested.paper_authors(shape.paper_authors(spark, folder), shape.authors(spark, folder))
    return listed.select("paper_id", "author_id", "position", "name", "name_normalized", "rank")


@query(
    "papers_with_authors_in_pages",
    """SELECT p.id, (coalesce(rank, 1) - 1) // 2 AS page, count(a.id)::INTEGER AS n_authors,
              coalesce(string_agg(a.name, '|' ORDER BY rank), '') AS author_names
       FROM c_papers p
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY position, author_id) AS rank
                  FROM c_paper_authors) b ON b.paper_id = p.id
       LEFT JOIN c_authors a ON a.id = b.author_id
       GROUP BY 1, 2""",
)
def papers_with_authors_in_pages(spark, folder):
    listed = nested.papers_with_authors(
        shape.papers(spark, folder), shape.paper_authors(spark, folder), shape.authors(spark, folder), 2
    )
    return listed.select(
        "id",
        "page",
        F.size("authors").alias("n_authors"),
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("author_names"),
    )


@query(
    "papers_with_authors",
    """SELECT p.id, p.title, 0::BIGINT AS page, count(a.id)::INTEGER AS n_authors,
              coalesce(string_agg(a.name, '|' ORDER BY b.position, a.id), '') AS author_names
       FROM c_papers p LEFT JOIN c_paper_authors b ON b.paper_id = p.id
       LEFT JOIN c_authors a ON a.id = b.author_id
       GROUP BY p.id, p.title""",
)
def papers_with_authors(spark, folder):
    listed = nested.papers_with_authors(
        shape.papers(spark, folder), shape.paper_authors(spark, folder), shape.authors(spark, folder)
    )
    return listed.select(
        "id",
        "title",
        "page",
        F.size("authors").alias("n_authors"),
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("author_names"),
    )


@query(
    "author_papers",
    """SELECT author_id, p.id AS paper_id, title, year, status,
              row_number() OVER (PARTITION BY author_id ORDER BY year DESC NULLS LAST, p.id) AS rank
       FROM c_paper_authors JOIN c_papers p ON paper_id = p.id""",
)
def author_papers(spark, folder):
    listed = nested.author_papers(shape.paper_authors(spark, folder), shape.papers(spark, folder))
    return listed.select("author_id", "paper_id", "title", "year", "status", "rank")


def _bucketed(spark, folder, links, key):
    """Links bucketed by one end, and papers bucketed by id."""
    root = new_path(spark, "bucketed")
    buckets.write_buckets(links(spark, folder), root, links.__name__, key, 8)
    buckets.write_buckets(shape.papers(spark, folder), root, "papers", "id", 8)
    return buckets.open_buckets(spark, root, links.__name__, key), buckets.open_buckets(spark, root, "papers", "id").light


@query(
    "author_papers_bucketed",
    """SELECT author_id, p.id AS paper_id, title, year, status,
              row_number() OVER (PARTITION BY author_id ORDER BY year DESC NULLS LAST, p.id) AS rank
       FROM c_paper_authors JOIN c_papers p ON paper_id = p.id""",
)
def author_papers_bucketed(spark, folder):
    listed = nested.author_papers(*_bucketed(spark, folder, shape.paper_authors, "paper_id"))
    return listed.select("author_id", "paper_id", "title", "year", "status", "rank")


@query(
    "cited_by_bucketed",
    """SELECT citing_paper_id, id, title, venue_id, year, status
       FROM c_citations JOIN c_papers ON id = cited_paper_id""",
)
def cited_by_bucketed(spark, folder):
    found = graph.cited_by(*_bucketed(spark, folder, shape.citations, "cited_paper_id"))
    return found.select("citing_paper_id", *BRIEF)


@query(
    "citing_bucketed",
    """SELECT cited_paper_id, id, title, venue_id, year, status
       FROM c_citations JOIN c_papers ON id = citing_paper_id""",
)
def citing_bucketed(spark, folder):
    found = graph.citing(*_bucketed(spark, folder, shape.citations, "citing_paper_id"))
    return found.select("cited_paper_id", *BRIEF)


@query(
    "cited_by",
    """SELECT citing_paper_id, id, title, venue_id, year, status
       FROM c_citations JOIN c_papers ON id = cited_paper_id""",
)
def cited_by(spark, folder):
    found = graph.cited_by(shape.citations(spark, folder), shape.papers(spark, folder))
    return found.select("citing_paper_id", *BRIEF)


@query(
    "citing",
    """SELECT cited_paper_id, id, title, venue_id, year, status
       FROM c_citations JOIN c_papers ON id = citing_paper_id""",
)
def citing(spark, folder):
    found = graph.citing(shape.citations(spark, folder), shape.papers(spark, folder))
    return found.select("cited_paper_id", *BRIEF)


@query(
    "citing_some",
    """SELECT cited_paper_id, id, title, venue_id, year, status
       FROM c_citations JOIN c_papers ON id = citing_paper_id
       WHERE cited_paper_id IN (SELECT s_suppkey FROM supplier)""",
)
def citing_some(spark, folder):
    keys = shape.table(spark, folder, "supplier").select("s_suppkey")
    found = graph.citing(shape.citations(spark, folder), shape.papers(spark, folder), keys)
    return found.select("cited_paper_id", *BRIEF)


@query(
    "conversations_with_queries",
    """SELECT c.id, c.title, 0::BIGINT AS page, count(q.id)::INTEGER AS n_queries,
              coalesce(string_agg(q.query_text, '|' ORDER BY q.created_at, q.id), '') AS texts
       FROM c_chats c LEFT JOIN c_queries q ON q.conversation_id = c.id
       GROUP BY c.id, c.title""",
)
def conversations_with_queries(spark, folder):
    listed = nested.conversations_with_queries(
        shape.chats(spark, folder), shape.queries(spark, folder)
    )
    return listed.select(
        "id",
        "title",
        "page",
        F.size("queries").alias("n_queries"),
        F.array_join(F.transform("queries", lambda q: q["query_text"]), "|").alias("texts"),
    )


@query(
    "papers_with_venue",
    """SELECT p.id, p.title, p.year, v.id AS venue_key, v.name AS venue_name, v.type AS venue_type
       FROM c_papers p LEFT JOIN c_venues v ON v.id = p.venue_id * 2""",
)
def papers_with_venue(spark, folder):
    # doubled, half of the venue ids name no venue
    papers = shape.papers(spark, folder).withColumn("venue_id", F.col("venue_id") * 2)
    joined = nested.papers_with_venue(papers, shape.venues(spark, folder))
    return joined.select(
        "id",
        "title",
        "year",
        F.col("venue.id").alias("venue_key"),
        F.col("venue.name").alias("venue_name"),
        F.col("venue.type").alias("venue_type"),
    )


# --- retrieval -------------------------------------------------------------

SIMILAR_SQL = """
    SELECT q.vec_id AS query_id, c.vec_id AS id,
           list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
    WHERE list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) >= 0.2"""


@query(
    "similar_vectors",
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank,
              id, round(similarity, 6) AS similarity
       FROM c_similar QUALIFY rank <= 10""",
    {"c_similar": SIMILAR_SQL},
)
def similar_vectors(spark, folder):
    """Every vector against all others. The vectors are random, so the cut is 0.2."""
    vectors = shape.vectors(spark, folder)
    found = retrieval.similar(vectors, vectors, 10, 0.2, skip_self=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "similar_vectors_by_blocks",
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank,
              id, round(similarity, 6) AS similarity
       FROM c_similar QUALIFY rank <= 10""",
    {"c_similar": SIMILAR_SQL},
)
def similar_vectors_by_blocks(spark, folder):
    """The same through blocks sorted by cell and angle, each visited by the queries that its bound lets in."""
    vectors = shape.vectors(spark, folder)
    layout = retrieval.lay_out(vectors, block_rows=256)
    found = retrieval.similar_by_blocks(vectors, layout, 10, 0.2, skip_self=True)
    return found.matches.withColumn("similarity", F.round("similarity", 6))


@query("similar_vectors_in_cells")
def similar_vectors_in_cells(spark, folder):
    """Approximate: every vector against those in the cells around it. Recall is tested, there is no SQL for it."""
    vectors = shape.vectors(spark, folder)
    layout = retrieval.lay_out(vectors, block_rows=256)
    return retrieval.similar_in_cells(vectors, layout, 10, 0.2, skip_self=True).matches


@query(
    "retrieved_ids",
    """SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
             FROM c_similar QUALIFY rank <= 10)
       GROUP BY query_id""",
    {"c_similar": SIMILAR_SQL},
)
def retrieved_ids(spark, folder):
    vectors = shape.vectors(spark, folder)
    found = retrieval.similar(vectors, vectors, 10, 0.2, skip_self=True)
    return retrieval.retrieved_ids(found).select(
        "query_id", F.array_join(F.col("retrieved_ids").cast("array<string>"), ",").alias("ids")
    )


# --- aggregation -----------------------------------------------------------


@query(
    "refresh_citation_counts",
    f"""SELECT p.id, p.title, coalesce(n, 0) AS citation_count, {NOW_SQL} AS updated_at
        FROM c_papers p LEFT JOIN (SELECT cited_paper_id, count(*) AS n FROM c_citations GROUP BY 1) e
          ON e.cited_paper_id = p.id""",
)
def refresh_citation_counts(spark, folder):
    counted = graph.refresh_citation_counts(
        shape.papers(spark, folder), shape.citations(spark, folder), NOW
    )
    return counted.select("id", "title", "citation_count", "updated_at")


@query(
    "papers_with_authors_and_counts",
    """SELECT p.id, p.title, coalesce(e.n, 0) AS citation_count, coalesce(b.names, '') AS author_names
       FROM c_papers p
       LEFT JOIN (SELECT cited_paper_id, count(*) AS n FROM c_citations GROUP BY 1) e ON e.cited_paper_id = p.id
       LEFT JOIN (SELECT paper_id, string_agg(name_normalized, '|' ORDER BY position, author_id) AS names
                  FROM c_paper_authors JOIN c_authors ON id = author_id GROUP BY 1) b ON b.paper_id = p.id""",
)
def papers_with_authors_and_counts(spark, folder):
    counted = graph.refresh_citation_counts(
        shape.papers(spark, folder), shape.citations(spark, folder), NOW
    )
    listed = nested.papers_with_authors(
        counted, shape.paper_authors(spark, folder), shape.authors(spark, folder)
    )
    names = F.transform("authors", lambda a: a["name_normalized"])
    return listed.select("id", "title", "citation_count", F.array_join(names, "|").alias("author_names"))
