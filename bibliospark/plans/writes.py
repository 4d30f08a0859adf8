"""Inserts, updates and deletes.

Batches are made from the driver's tables so that every rule is broken by
some rows. Large ids in the SQL repeat what the operators are told to start
above.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliospark.operators import changes, graph, ingest, maintenance, spread
from bibliospark.plans.base import NOW, NOW_SQL, query
from bibliospark.schemas import DEFAULT_VENUES, TABLES
from bibliospark.sources import driver_tables as shape
from bibliospark.sources import ranges
from bibliospark.sources.durable import keep, new_path

# --- venues ----------------------------------------------------------------

SEEDS = ", ".join(f"({i}, '{n}', '{t}', '{u}')" for i, (n, t, u) in enumerate(DEFAULT_VENUES))


@query(
    "seed_venues",
    """SELECT id, name, type, url FROM c_venues
       UNION ALL
       SELECT (SELECT max(id) FROM c_venues) + row_number() OVER (ORDER BY seq), name, type, url
       FROM c_seeds WHERE name NOT IN (SELECT name FROM c_venues)""",
    {"c_seeds": f"SELECT * FROM (VALUES {SEEDS}) AS v(seq, name, type, url)"},
)
def seed_venues(spark, folder):
    venues = shape.venues(spark, folder)
    return ingest.seed_venues(venues, spread.high_water(venues), NOW).drop("created_at")


VENUE_BATCH = {
    "b_venues": """
        SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN c_custkey - 1 ELSE c_custkey END AS seq,
               'NATION_' || (c_nationkey + 5) AS name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'conference' WHEN 'AUTOMOBILE' THEN 'journal'
                    WHEN 'HOUSEHOLD' THEN 'preprint' WHEN 'MACHINERY' THEN 'workshop' END AS type
        FROM customer""",
    "v_venues": """
        SELECT *, CASE WHEN seq IS NULL THEN 'order_null' WHEN NOT alone THEN 'order_repeated'
                       WHEN type IS NULL THEN 'not_null' WHEN type = 'workshop' THEN 'check'
                       WHEN name IN (SELECT name FROM c_venues)
                         OR seq > min(CASE WHEN alone AND type <> 'workshop' THEN seq END) OVER (PARTITION BY name) THEN 'duplicate' END AS reason
        FROM (SELECT *, count(*) OVER (PARTITION BY seq) = 1 AND seq IS NOT NULL AS alone FROM b_venues)""",
}


def _insert_venues(spark, folder):
    segment, number = F.col("c_mktsegment"), F.col("c_custkey")
    batch = shape.table(spark, folder, "customer").select(
        F.when(number % 11 == 0, None).when(number % 13 == 1, number - 1).otherwise(number).alias("seq"),
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey") + 5).alias("name"),
        F.when(segment == "BUILDING", "conference")
        .when(segment == "AUTOMOBILE", "journal")
        .when(segment == "HOUSEHOLD", "preprint")
        .when(segment == "MACHINERY", "workshop")
        .alias("type"),
    )
    venues = shape.venues(spark, folder)
    return ingest.insert_venues(batch, venues, spread.high_water(venues), NOW)


@query(
    "insert_venues",
    f"""SELECT (SELECT max(id) FROM c_venues) + row_number() OVER (ORDER BY seq) AS id, name, type,
               NULL::VARCHAR AS url, {NOW_SQL} AS created_at
        FROM v_venues WHERE reason IS NULL""",
    VENUE_BATCH,
)
def insert_venues(spark, folder):
    return _insert_venues(spark, folder).accepted


@query(
    "insert_venues_rejected",
    """SELECT seq, reason, CASE WHEN reason = 'duplicate' THEN 'name' WHEN reason LIKE 'order%' THEN 'seq' ELSE 'type' END AS key,
              CASE reason WHEN 'duplicate' THEN 'duplicate' ELSE 'integrity' END AS reported_as
       FROM v_venues WHERE reason IS NOT NULL""",
    VENUE_BATCH,
)
def insert_venues_rejected(spark, folder):
    return _insert_venues(spark, folder).rejected


# --- authors ---------------------------------------------------------------

AUTHOR_BATCH = {
    "b_authors": """
        SELECT o_orderkey AS seq, ' Supplier#' || lpad((o_custkey // 10)::VARCHAR, 9, '0') || chr(9) AS name,
               'supplier#' || lpad((o_custkey // 10)::VARCHAR, 9, '0') AS name_normalized
        FROM orders""",
    "v_authors": """
        SELECT *, name_normalized IN (SELECT name_normalized FROM c_authors)
                  OR seq > min(seq) OVER (PARTITION BY name_normalized) AS refused
        FROM b_authors""",
}


def _insert_authors(spark, folder):
    number = F.lpad(F.floor(F.col("o_custkey") / 10).cast("string"), 9, "0")
    batch = shape.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit(" Supplier#"), number, F.lit("\t")).alias("name"),
    )
    authors = shape.authors(spark, folder)
    return ingest.insert_authors(batch, authors, spread.high_water(authors), NOW)


@query(
    "insert_authors",
    f"""SELECT (SELECT max(id) FROM c_authors) + row_number() OVER (ORDER BY seq) AS id, name, name_normalized,
               0 AS n_affiliations, {NOW_SQL} AS created_at
        FROM v_authors WHERE NOT refused""",
    AUTHOR_BATCH,
)
def insert_authors(spark, folder):
    added = _insert_authors(spark, folder).accepted
    return added.select(
        "id", "name", "name_normalized", F.size("affiliations").alias("n_affiliations"), "created_at"
    )


@query(
    "insert_authors_rejected",
    """SELECT seq, 'duplicate' AS reason, 'name_normalized' AS key, 'duplicate' AS reported_as
       FROM v_authors WHERE refused""",
    AUTHOR_BATCH,
)
def insert_authors_rejected(spark, folder):
    return _insert_authors(spark, folder).rejected


MENTIONS = {
    "b_mentions": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'SUPPLIER#' || lpad((l_suppkey + 30)::VARCHAR, 9, '0') AS name
        FROM lineitem""",
    "new_authors": """
        SELECT (SELECT max(id) FROM c_authors)
               + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS id,
               name, lower(name) AS name_normalized
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS nth
              FROM b_mentions WHERE lower(name) NOT IN (SELECT name_normalized FROM c_authors))
        WHERE nth = 1""",
}
MENTION_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


def _resolve(spark, folder):
    name = F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("l_suppkey") + 30).cast("string"), 9, "0"))
    mentions = shape.table(spark, folder, "lineitem").select(*MENTION_ORDER, name.alias("name"))
    authors = shape.authors(spark, folder)
    return ingest.resolve_authors(
        mentions, authors, spread.high_water(authors), NOW, MENTION_ORDER
    )


@query(
    "resolve_authors",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(a.id, n.id) AS author_id
       FROM b_mentions m LEFT JOIN c_authors a ON a.name_normalized = lower(m.name)
       LEFT JOIN new_authors n ON n.name_normalized = lower(m.name)""",
    MENTIONS,
)
def resolve_authors(spark, folder):
    return _resolve(spark, folder).mentions.select(*MENTION_ORDER, "author_id")


@query("resolve_authors_added", "SELECT id, name, name_normalized FROM new_authors", MENTIONS)
def resolve_authors_added(spark, folder):
    return _resolve(spark, folder).added.select("id", "name", "name_normalized")


# --- papers ----------------------------------------------------------------

# Venue 25 does not exist; a customer's year and a day's priority repeat.
PAPER_BATCH = {
    "b_papers": """
        SELECT o_orderkey AS seq, 'paper ' || o_orderkey AS title, c_nationkey::BIGINT + 1 AS venue_id,
               year(o_orderdate)::INTEGER AS year, o_custkey || '-' || year(o_orderdate) AS arxiv_id,
               CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') || o_orderpriority END AS doi
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "stored_papers": """
        SELECT doc_id AS id, doc_id || '-1998' AS arxiv_id, NULL::VARCHAR AS doi FROM documents""",
    "open_papers": """
        SELECT seq, arxiv_id, doi FROM b_papers
        WHERE venue_id < 25 AND arxiv_id NOT IN (SELECT arxiv_id FROM stored_papers)""",
    "rounds": """
        SELECT 0 AS round, seq, arxiv_id, doi FROM open_papers
        UNION ALL
        SELECT round + 1, seq, arxiv_id, doi
        FROM (SELECT *, bool_or(won) OVER (PARTITION BY arxiv_id) AS taken_a,
                     doi IS NOT NULL AND bool_or(won) OVER (PARTITION BY doi) AS taken_d
              FROM (SELECT *, seq = min(seq) OVER (PARTITION BY arxiv_id)
                              AND (doi IS NULL OR seq = min(seq) OVER (PARTITION BY doi)) AS won
                    FROM rounds))
        WHERE NOT taken_a AND NOT taken_d""",
    "won_papers": """
        SELECT seq, (SELECT max(id) FROM stored_papers) + row_number() OVER (ORDER BY seq) AS id
        FROM (SELECT seq, seq = min(seq) OVER (PARTITION BY round, arxiv_id)
                     AND (doi IS NULL OR seq = min(seq) OVER (PARTITION BY round, doi)) AS won
              FROM rounds)
        WHERE won""",
}
LINK_BATCH = {
    **PAPER_BATCH,
    "b_lists": """
        SELECT l_orderkey AS seq,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)::INTEGER AS position,
               'SUPPLIER#' || lpad((l_suppkey + 30)::VARCHAR, 9, '0') AS name
        FROM lineitem""",
    "won_lists": """
        SELECT seq, id AS paper_id, position, name, lower(name) AS name_normalized
        FROM b_lists JOIN won_papers USING (seq)""",
    "made_authors": """
        SELECT (SELECT max(id) FROM c_authors) + row_number() OVER (ORDER BY seq, position) AS id, name, name_normalized
        FROM (SELECT *, row_number() OVER (PARTITION BY name_normalized ORDER BY seq, position) AS nth
              FROM won_lists WHERE name_normalized NOT IN (SELECT name_normalized FROM c_authors))
        WHERE nth = 1""",
    "won_links": """
        SELECT w.seq, w.paper_id, w.position, coalesce(a.id, m.id) AS author_id
        FROM won_lists w LEFT JOIN c_authors a USING (name_normalized)
        LEFT JOIN made_authors m USING (name_normalized)""",
}


def _insert_papers(spark, folder):
    customer = shape.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).alias("venue_id")
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    batch = shape.table(spark, folder, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("paper "), F.col("o_orderkey")).alias("title"),
        "venue_id",
        F.year("o_orderdate").alias("year"),
        F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("arxiv_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(day, F.col("o_orderpriority"))).alias("doi"),
    )
    stored = shape.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("doc_id"), F.lit("-1998")).alias("arxiv_id"),
        F.lit(None).cast("string").alias("doi"),
    )
    in_list = [F.col(c).asc() for c in ("l_linenumber", "l_suppkey", "l_partkey")]
    lists = spread.rank_within(
        shape.table(spark, folder, "lineitem"), "l_orderkey", in_list, "position"
    ).select(
        F.col("l_orderkey").alias("seq"),
        F.col("position").cast("int"),
        F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("l_suppkey") + 30).cast("string"), 9, "0")).alias("name"),
    )
    authors = shape.authors(spark, folder)
    return ingest.insert_papers(
        batch,
        stored,
        authors,
        shape.venues(spark, folder),
        spread.high_water(stored),
        spread.high_water(authors),
        lists,
        NOW,
    )


@query(
    "insert_papers",
    f"""SELECT w.id, title, venue_id, year, arxiv_id, doi, 'pending' AS status, 0::BIGINT AS citation_count,
               {NOW_SQL} AS created_at, {NOW_SQL} AS updated_at
        FROM won_papers w JOIN b_papers USING (seq)""",
    PAPER_BATCH,
)
def insert_papers(spark, folder):
    added = _insert_papers(spark, folder).papers
    return added.select(
        "id", "title", "venue_id", "year", "arxiv_id", "doi", "status", "citation_count",
        "created_at", "updated_at",
    )


@query(
    "insert_papers_rejected",
    """SELECT seq, CASE WHEN dup IS NULL THEN 'foreign_key' ELSE 'duplicate' END AS reason,
              coalesce(dup, 'venue_id') AS key,
              CASE WHEN dup IS NULL THEN 'integrity' ELSE 'duplicate' END AS reported_as
       FROM (SELECT b.seq,
                    CASE WHEN b.arxiv_id IN (SELECT arxiv_id FROM stored_papers) OR a.seq < b.seq THEN 'arxiv_id'
                         WHEN d.seq < b.seq THEN 'doi' END AS dup
             FROM b_papers b
             LEFT JOIN (SELECT seq, arxiv_id FROM b_papers JOIN won_papers USING (seq)) a ON a.arxiv_id = b.arxiv_id
             LEFT JOIN (SELECT seq, doi FROM b_papers JOIN won_papers USING (seq)) d ON d.doi = b.doi
             WHERE b.seq NOT IN (SELECT seq FROM won_papers))""",
    PAPER_BATCH,
)
def insert_papers_rejected(spark, folder):
    return _insert_papers(spark, folder).rejected


@query(
    "insert_papers_links",
    "SELECT paper_id, author_id, min(position) AS position FROM won_links GROUP BY paper_id, author_id",
    LINK_BATCH,
)
def insert_papers_links(spark, folder):
    return _insert_papers(spark, folder).paper_authors


@query("insert_papers_authors", "SELECT id, name, name_normalized FROM made_authors", LINK_BATCH)
def insert_papers_authors(spark, folder):
    return _insert_papers(spark, folder).authors.select("id", "name", "name_normalized")


@query(
    "insert_papers_repeated_links",
    """SELECT seq, position, 'duplicate' AS reason, 'paper_id,author_id' AS key
       FROM won_links QUALIFY position > min(position) OVER (PARTITION BY paper_id, author_id)""",
    LINK_BATCH,
)
def insert_papers_repeated_links(spark, folder):
    return _insert_papers(spark, folder).rejected_links


# --- links and citations ---------------------------------------------------

CITATION_BATCH = {
    "b_citations": """
        SELECT o_orderkey AS seq, o_custkey AS citing_paper_id, floor(o_totalprice / 25000)::BIGINT AS cited_paper_id
        FROM orders""",
    "stored_citations": "SELECT c_custkey AS citing_paper_id, c_nationkey::BIGINT AS cited_paper_id FROM customer",
    "v_citations": """
        SELECT *, CASE WHEN (citing_paper_id, cited_paper_id) IN (SELECT (citing_paper_id, cited_paper_id) FROM stored_citations)
                         OR (known AND seq > min(seq) FILTER (known) OVER (PARTITION BY citing_paper_id, cited_paper_id)) THEN 'duplicate'
                       WHEN NOT known THEN 'foreign_key' END AS reason
        FROM (SELECT *, citing_paper_id IN (SELECT doc_id FROM documents) AS known FROM b_citations)""",
}


def _insert_citations(spark, folder):
    batch = shape.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("citing_paper_id"),
        F.floor(F.col("o_totalprice") / 25000).alias("cited_paper_id"),
    )
    stored = shape.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("citing_paper_id"),
        F.col("c_nationkey").cast("bigint").alias("cited_paper_id"),
    )
    papers = shape.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return ingest.insert_citations(batch, stored, papers, NOW)


@query(
    "insert_citations",
    f"""SELECT citing_paper_id, cited_paper_id, {NOW_SQL} AS created_at FROM v_citations WHERE reason IS NULL""",
    CITATION_BATCH,
)
def insert_citations(spark, folder):
    return _insert_citations(spark, folder).accepted


@query(
    "insert_citations_rejected",
    """SELECT seq, reason, CASE reason WHEN 'duplicate' THEN 'citing_paper_id,cited_paper_id' ELSE 'citing_paper_id' END AS key,
              'duplicate' AS reported_as
       FROM v_citations WHERE reason IS NOT NULL""",
    CITATION_BATCH,
)
def insert_citations_rejected(spark, folder):
    return _insert_citations(spark, folder).rejected


LINKS = {
    "b_links": """
        SELECT o_orderkey AS seq, o_custkey AS paper_id, floor(o_totalprice / 20000)::BIGINT AS author_id,
               month(o_orderdate)::INTEGER AS position
        FROM orders""",
    "v_links": """
        SELECT *, CASE WHEN NOT known THEN 'foreign_key'
                       WHEN seq > min(seq) FILTER (known) OVER (PARTITION BY paper_id, author_id) THEN 'duplicate' END AS reason
        FROM (SELECT *, author_id IN (SELECT id FROM c_authors) AS known FROM b_links)""",
}


def _insert_links(spark, folder):
    batch = shape.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("paper_id"),
        F.floor(F.col("o_totalprice") / 20000).alias("author_id"),
        F.month("o_orderdate").alias("position"),
    )
    authors = shape.authors(spark, folder)
    papers = shape.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    none = spark.createDataFrame([], TABLES["paper_authors"])
    return ingest.insert_links(batch, none, papers, authors)


@query(
    "insert_links",
    "SELECT paper_id, author_id, position FROM v_links WHERE reason IS NULL",
    LINKS,
)
def insert_links(spark, folder):
    return _insert_links(spark, folder).accepted


@query(
    "insert_links_rejected",
    """SELECT seq, reason, CASE reason WHEN 'duplicate' THEN 'paper_id,author_id' ELSE 'author_id' END AS key,
              CASE reason WHEN 'duplicate' THEN 'duplicate' ELSE 'integrity' END AS reported_as
       FROM v_links WHERE reason IS NOT NULL""",
    LINKS,
)
def insert_links_rejected(spark, folder):
    return _insert_links(spark, folder).rejected


# --- conversations, queries and the log ------------------------------------


@query(
    "open_conversations",
    f"""SELECT 500 + row_number() OVER (ORDER BY doc_id) AS id,
               CASE WHEN lang <> 'en' THEN text END AS title, {NOW_SQL} AS created_at, {NOW_SQL} AS updated_at
        FROM documents""",
)
def open_conversations(spark, folder):
    batch = shape.table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), F.when(F.col("lang") != "en", F.col("text")).alias("title")
    )
    return ingest.insert_conversations(batch, 500, NOW)


QUERY_BATCH = {
    "b_queries": """
        SELECT id AS seq, CASE WHEN turn = 1 THEN NULL ELSE conversation_id * 2 END AS conversation_id,
               CASE WHEN response_text IS NOT NULL THEN query_text END AS query_text,
               response_text, '[' || conversation_id || ', ' || turn || CASE turn WHEN 2 THEN '' WHEN 4 THEN ']}' ELSE ']' END AS retrieved_ids
        FROM (SELECT *, retrieved_ids[2] AS turn FROM c_queries)""",
    "v_queries": """
        SELECT *, CASE WHEN retrieved_ids NOT LIKE '%]' THEN 'malformed_json' WHEN query_text IS NULL THEN 'not_null'
                       WHEN conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT id FROM c_chats) THEN 'foreign_key' END AS reason
        FROM b_queries""",
}


def _insert_queries(spark, folder):
    turn = F.get("retrieved_ids", F.lit(1))
    told = shape.queries(spark, folder)
    batch = told.select(
        F.col("id").alias("seq"),
        F.when(turn != 1, F.col("conversation_id") * 2).alias("conversation_id"),
        F.when(F.col("response_text").isNotNull(), F.col("query_text")).alias("query_text"),
        "response_text",
        F.concat(
            F.lit("["), "conversation_id", F.lit(", "), turn, F.when(turn == 2, "").when(turn == 4, "]}").otherwise("]")
        ).alias("retrieved_ids"),
    )
    return ingest.insert_queries(batch, shape.chats(spark, folder), 1000, NOW)


@query(
    "insert_queries",
    f"""SELECT 1000 + row_number() OVER (ORDER BY seq) AS id, conversation_id, query_text, response_text,
               (TRY_CAST(TRY_CAST(retrieved_ids AS JSON) AS BIGINT[]))[2] AS second_id, NULL::VARCHAR AS model_used, {NOW_SQL} AS created_at
        FROM v_queries WHERE reason IS NULL""",
    QUERY_BATCH,
)
def insert_queries(spark, folder):
    added = _insert_queries(spark, folder).accepted
    return added.select(
        "id", "conversation_id", "query_text", "response_text",
        F.get("retrieved_ids", F.lit(1)).alias("second_id"), "model_used", "created_at",
    )


@query(
    "insert_queries_rejected",
    """SELECT seq, reason, CASE reason WHEN 'malformed_json' THEN 'retrieved_ids' WHEN 'not_null' THEN 'query_text'
                                ELSE 'conversation_id' END AS key, 'integrity' AS reported_as
       FROM v_queries WHERE reason IS NOT NULL""",
    QUERY_BATCH,
)
def insert_queries_rejected(spark, folder):
    return _insert_queries(spark, folder).rejected


@query(
    "insert_queries_conversations",
    f"""SELECT id, title, created_at,
               CASE WHEN id IN (SELECT conversation_id FROM v_queries WHERE reason IS NULL)
                    THEN {NOW_SQL} ELSE updated_at END AS updated_at
        FROM c_chats""",
    QUERY_BATCH,
)
def insert_queries_conversations(spark, folder):
    return _insert_queries(spark, folder).conversations


LOG_BATCH = {
    "b_log": """
        SELECT id AS seq, CASE WHEN status = 'failed' THEN NULL ELSE paper_id * 10 END AS paper_id,
               CASE WHEN message LIKE '%7}' THEN 'publish' ELSE stage END AS stage,
               CASE WHEN message LIKE '%9}' THEN NULL WHEN message LIKE '%8}' THEN 'skipped' ELSE status END AS status, message
        FROM c_log""",
    "v_log": """
        SELECT *, CASE WHEN status IS NULL THEN 'not_null' WHEN stage = 'publish' OR status = 'skipped' THEN 'check'
                       WHEN paper_id IS NOT NULL AND paper_id NOT IN (SELECT doc_id FROM documents) THEN 'foreign_key' END AS reason,
               CASE WHEN status IS NULL THEN 'status' WHEN stage = 'publish' THEN 'stage' WHEN status = 'skipped' THEN 'status'
                    ELSE 'paper_id' END AS key
        FROM b_log""",
}


def log_batch(events):
    message = F.col("message")
    return shape.log_entries(events).select(
        F.col("id").alias("seq"),
        F.when(F.col("status") != "failed", F.col("paper_id") * 10).alias("paper_id"),
        F.when(message.endswith("7}"), "publish").otherwise(F.col("stage")).alias("stage"),
        F.when(message.endswith("9}"), None)
        .when(message.endswith("8}"), "skipped")
        .otherwise(F.col("status"))
        .alias("status"),
        "message",
    )


def log_papers(spark, folder):
    return shape.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))


def _append_log(spark, folder):
    batch = log_batch(shape.table(spark, folder, "events"))
    return ingest.append_log(batch, log_papers(spark, folder), 77, NOW)


@query(
    "append_log",
    f"""SELECT 77 + row_number() OVER (ORDER BY seq) AS id, paper_id, stage, status, message, {NOW_SQL} AS created_at
        FROM v_log WHERE reason IS NULL""",
    LOG_BATCH,
)
def append_log(spark, folder):
    return _append_log(spark, folder).accepted


@query(
    "append_log_rejected",
    "SELECT seq, reason, key, 'integrity' AS reported_as FROM v_log WHERE reason IS NOT NULL",
    LOG_BATCH,
)
def append_log_rejected(spark, folder):
    return _append_log(spark, folder).rejected


# --- updates ---------------------------------------------------------------


@query(
    "set_affiliations",
    """SELECT id, name_normalized, coalesce(string_agg_new, affiliations[1]) AS affiliations
       FROM c_authors LEFT JOIN (
         SELECT c_custkey * 3 AS id, c_name || '|' || c_mktsegment AS string_agg_new FROM customer) USING (id)""",
)
def set_affiliations(spark, folder):
    new = shape.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("seq"),
        (F.col("c_custkey") * 3).alias("id"),
        F.array("c_name", "c_mktsegment").alias("affiliations"),
    )
    after = changes.set_affiliations(shape.authors(spark, folder), new)
    return after.select("id", "name_normalized", F.array_join("affiliations", "|").alias("affiliations"))


# The last allowed event of a paper decides: a purchase asks for an unknown status.
STATUS_CHANGES = {
    "b_status": """
        SELECT event_id AS seq, user_id AS id,
               CASE event_type WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'ready' WHEN 'signup' THEN 'extracting'
                    WHEN 'error' THEN NULL ELSE 'published' END AS status
        FROM events""",
}


def _set_status(spark, folder):
    kind = F.col("event_type")
    asked = shape.table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        F.when(kind == "view", "downloading")
        .when(kind == "click", "ready")
        .when(kind == "signup", "extracting")
        .when(kind == "error", None)
        .otherwise("published")
        .alias("status"),
    )
    return changes.set_status(shape.papers(spark, folder), asked, NOW)


@query(
    "set_status",
    f"""SELECT p.id, title, CASE WHEN l.id IS NULL THEN p.status ELSE l.status END AS status,
               CASE WHEN l.id IS NULL THEN updated_at ELSE {NOW_SQL} END AS updated_at
        FROM c_papers p LEFT JOIN (
          SELECT id, status FROM b_status WHERE status IS NULL OR status <> 'published'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) l ON l.id = p.id""",
    STATUS_CHANGES,
)
def set_status(spark, folder):
    return _set_status(spark, folder).accepted.select("id", "title", "status", "updated_at")


@query(
    "set_status_rejected",
    """SELECT seq, 'check' AS reason, 'status' AS key, 'integrity' AS reported_as
       FROM b_status WHERE status = 'published' AND id IN (SELECT id FROM c_papers)""",
    STATUS_CHANGES,
)
def set_status_rejected(spark, folder):
    return _set_status(spark, folder).rejected


@query(
    "set_full_text",
    f"""SELECT id, coalesce(text, full_text) AS full_text, CASE WHEN text IS NULL THEN status ELSE 'extracted' END AS status,
               CASE WHEN text IS NULL THEN updated_at ELSE {NOW_SQL} END AS updated_at
        FROM c_papers LEFT JOIN documents ON doc_id = id""",
)
def set_full_text(spark, folder):
    new = shape.table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("text").alias("full_text")
    )
    after = changes.set_full_text(shape.papers(spark, folder), new, NOW)
    return after.select("id", "full_text", "status", "updated_at")


@query(
    "set_full_text_by_range",
    f"""SELECT id, coalesce(text, full_text) AS full_text, CASE WHEN text IS NULL THEN status ELSE 'extracted' END AS status,
               CASE WHEN text IS NULL THEN updated_at ELSE {NOW_SQL} END AS updated_at
        FROM c_papers LEFT JOIN documents ON doc_id = id""",
)
def set_full_text_by_range(spark, folder):
    """The same in place: only the id ranges that hold a change are rewritten."""
    new = shape.table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("text").alias("full_text")
    )
    root = new_path(spark, "ranges")
    ranges.write_ranges(shape.papers(spark, folder), root, "papers", 5_000)
    ranges.patch(spark, root, "papers", new, lambda rows, few: changes.set_full_text(rows, few, NOW), "texts")
    return ranges.read_ranges(spark, root, "papers").select("id", "full_text", "status", "updated_at")


@query(
    "merge_citation_counts",
    """SELECT p.id, coalesce(n, 0) AS citation_count
       FROM c_papers p LEFT JOIN (
           SELECT cited_paper_id, count(*) AS n FROM c_citations
           WHERE citing_paper_id NOT IN (SELECT s_suppkey FROM supplier) AND cited_paper_id NOT IN (SELECT s_suppkey FROM supplier)
           GROUP BY 1) e ON e.cited_paper_id = p.id
       WHERE p.id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def merge_citation_counts(spark, folder):
    """Counts of a first batch of citations, brought up to date with a second batch and a cascade."""
    edges, papers = shape.citations(spark, folder), shape.papers(spark, folder)
    part = shape.table(spark, folder, "nation").select((F.col("n_nationkey") * 3).alias("citing_paper_id"))
    first = edges.join(part, "citing_paper_id", "left_anti")
    second = edges.join(part, "citing_paper_id", "left_semi")
    root = new_path(spark, "ranges")
    ranges.write_ranges(graph.refresh_citation_counts(papers, first, NOW), root, "papers", 5_000)
    maintenance.merge_counts(spark, root, "second", second, now=NOW)
    gone = keep(shape.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id")), "gone")
    maintenance.merge_counts(spark, root, "cascade", removed=graph.edges_of(edges, gone), now=NOW)
    ranges.patch(spark, root, "papers", gone, lambda rows, few: rows.join(few, "id", "left_anti"), "deleted")
    return ranges.read_ranges(spark, root, "papers").select("id", "citation_count")


@query(
    "mark_embedded",
    f"""SELECT id, coalesce(model, embedding_model) AS embedding_model,
               CASE WHEN model IS NULL THEN embedded_at ELSE {NOW_SQL} END AS embedded_at,
               CASE WHEN model IS NULL THEN status ELSE 'ready' END AS status,
               CASE WHEN model IS NULL THEN updated_at ELSE {NOW_SQL} END AS updated_at
        FROM c_papers LEFT JOIN (SELECT vec_id AS id, 'model-' || label AS model FROM embeddings) USING (id)""",
)
def mark_embedded(spark, folder):
    new = shape.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("seq"),
        F.col("vec_id").alias("id"),
        F.concat(F.lit("model-"), F.col("label")).alias("embedding_model"),
    )
    after = changes.mark_embedded(shape.papers(spark, folder), new, NOW)
    return after.select("id", "embedding_model", "embedded_at", "status", "updated_at")


@query(
    "touch_papers",
    f"""SELECT id, title, CASE WHEN id IN (SELECT l_partkey FROM lineitem) THEN {NOW_SQL} ELSE updated_at END AS updated_at
        FROM c_papers""",
)
def touch_papers(spark, folder):
    ids = shape.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    return changes.touch_papers(shape.papers(spark, folder), ids, NOW).select("id", "title", "updated_at")


@query(
    "touch_conversations",
    """SELECT id, title, created_at, greatest(moved, newest) AS updated_at
       FROM (SELECT *, updated_at + to_days(((id % 3) * 400)::INTEGER) AS moved FROM c_chats)
       LEFT JOIN (SELECT user_id AS id, max(ts) AS newest FROM events GROUP BY 1) USING (id)""",
)
def touch_conversations(spark, folder):
    asked = shape.table(spark, folder, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at")
    )
    # stored times on both sides of the newest query, which may not move them back
    later = F.make_dt_interval((F.col("id") % 3 * 400).cast("int"))
    chats = shape.chats(spark, folder).withColumn("updated_at", F.col("updated_at") + later)
    return changes.touch_conversations(chats, asked)


# --- deletes ---------------------------------------------------------------


def _delete_papers(spark, folder):
    """Delete the papers that vectors name."""
    ids = shape.table(spark, folder, "embeddings").select((F.col("vec_id") * 5).alias("id"))
    return changes.delete_papers(
        ids,
        shape.papers(spark, folder),
        shape.paper_authors(spark, folder),
        shape.citations(spark, folder),
        shape.processing_log(spark, folder),
    )


GONE = {"gone": "SELECT vec_id * 5 AS id FROM embeddings"}
NOT_GONE = "NOT IN (SELECT id FROM gone)"


@query("delete_papers", f"SELECT id, title, citation_count FROM c_papers WHERE id {NOT_GONE}", GONE)
def delete_papers(spark, folder):
    return _delete_papers(spark, folder).tables["papers"].select("id", "title", "citation_count")


@query("delete_papers_links", f"SELECT * FROM c_paper_authors WHERE paper_id {NOT_GONE}", GONE)
def delete_papers_links(spark, folder):
    return _delete_papers(spark, folder).tables["paper_authors"]


@query(
    "delete_papers_citations",
    f"SELECT * FROM c_citations WHERE citing_paper_id {NOT_GONE} AND cited_paper_id {NOT_GONE}",
    GONE,
)
def delete_papers_citations(spark, folder):
    return _delete_papers(spark, folder).tables["citations"].drop("created_at")


@query("delete_papers_log", f"SELECT * FROM c_log WHERE paper_id {NOT_GONE}", GONE)
def delete_papers_log(spark, folder):
    return _delete_papers(spark, folder).tables["processing_log"]


@query("deleted_papers", "SELECT id FROM c_papers WHERE id IN (SELECT id FROM gone)", GONE)
def deleted_papers(spark, folder):
    return _delete_papers(spark, folder).deleted


@query(
    "delete_conversations",
    """SELECT 'conversation' AS kind, id FROM c_chats WHERE id NOT IN (SELECT n_nationkey * 2 FROM nation)
       UNION ALL
       SELECT 'query', id FROM c_queries WHERE conversation_id NOT IN (SELECT n_nationkey * 2 FROM nation)""",
)
def delete_conversations(spark, folder):
    ids = shape.table(spark, folder, "nation").select((F.col("n_nationkey") * 2).alias("id"))
    after = changes.delete_conversations(
        ids, shape.chats(spark, folder), shape.queries(spark, folder)
    ).tables
    return (
        after["conversations"].select(F.lit("conversation").alias("kind"), "id")
        .unionByName(after["queries"].select(F.lit("query").alias("kind"), "id"))
    )


@query(
    "delete_authors",
    """SELECT paper_id, author_id, position, name_normalized
       FROM c_paper_authors JOIN c_authors ON id = author_id WHERE id NOT IN (SELECT n_nationkey * 2 FROM nation)""",
)
def delete_authors(spark, folder):
    ids = shape.table(spark, folder, "nation").select((F.col("n_nationkey") * 2).alias("id"))
    after = changes.delete_authors(
        ids, shape.authors(spark, folder), shape.paper_authors(spark, folder)
    ).tables
    who = after["authors"].select(F.col("id").alias("author_id"), "name_normalized")
    return after["paper_authors"].join(who, "author_id")


def _delete_venues(spark, folder):
    """Ask to delete all venues; papers of venue n name venue 2n here, so odd venues are not in use."""
    venues = shape.venues(spark, folder)
    papers = shape.papers(spark, folder).withColumn("venue_id", F.col("venue_id") * 2)
    return changes.delete_venues(venues.select("id"), venues, papers)


USED = {"used": "SELECT venue_id * 2 AS id FROM c_papers"}


@query("delete_venues", "SELECT id, name, type FROM c_venues WHERE id IN (SELECT id FROM used)", USED)
def delete_venues(spark, folder):
    return _delete_venues(spark, folder).venues.select("id", "name", "type")


@query(
    "delete_venues_rejected",
    "SELECT id, 'foreign_key' AS reason, 'venue_id' AS key FROM c_venues WHERE id IN (SELECT id FROM used)",
    USED,
)
def delete_venues_rejected(spark, folder):
    return _delete_venues(spark, folder).rejected
