"""The driver's tables in the shape of corpus tables.

``SQL`` states the same shapes for the SQL side of a check; each entry is the
body of a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.functions.scalars import normalize_name

def epoch() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def venues(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.pmod("n_regionkey", F.lit(3))
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.when(kind == 0, "conference").when(kind == 1, "journal").otherwise("preprint").alias("type"),
        F.concat(F.lit("https://venue/"), F.col("n_nationkey")).alias("url"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


def authors(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.col("s_name"), F.lit(" "))
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        name.alias("name"),
        normalize_name(name).alias("name_normalized"),
        F.array(F.concat(F.lit("nation "), F.col("s_nationkey"))).alias("affiliations"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


def papers(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("venue_id")
    )
    text = F.lit(None).cast("string")
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"),
        F.concat(F.lit("by "), F.col("o_custkey")).alias("abstract"),
        text.alias("full_text"),
        "venue_id",
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("arx."), F.col("o_orderkey"))).alias("arxiv_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("10/"), F.col("o_orderkey"))).alias("doi"),
        text.alias("pdf_url"),
        text.alias("pdf_path"),
        F.when(status == "P", "pending").when(status == "O", "extracted").otherwise("failed").alias("status"),
        F.lit(0).cast("bigint").alias("citation_count"),
        F.when(status == "O", "model-a").alias("embedding_model"),
        F.when(status == "O", F.col("o_orderdate")).alias("embedded_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def paper_authors(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"))
        .agg(F.min("l_linenumber").alias("position"))
    )


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("citing_paper_id"), F.col("l_partkey").alias("cited_paper_id")
    ).distinct().withColumn("created_at", F.lit(None).cast("timestamp_ntz"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """One conversation per user of ``events``, active at the times of the events."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        .select("id", F.concat(F.lit("user "), F.col("id")).alias("title"), "created_at", "updated_at")
    )


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """One conversation per ``conv_id``, all made at the same time."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("id")).distinct().select(
        "id",
        F.concat(F.lit("chat "), F.col("id")).alias("title"),
        epoch().alias("created_at"),
        epoch().alias("updated_at"),
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn is a query; the next turn, if an assistant's, is its response."""
    turns = table(spark, folder, "conversations")
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text")
    )
    return turns.where("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("conversation_id"),
        F.col("text").alias("query_text"),
        "response_text",
        F.array("conv_id", "turn").alias("retrieved_ids"),
        F.lit("model-a").alias("model_used"),
        F.length("text").alias("latency_ms"),
        (epoch() + F.make_dt_interval(secs=F.col("turn"))).alias("created_at"),
    )


def processing_log(spark: SparkSession, folder: str) -> DataFrame:
    return log_entries(table(spark, folder, "events"))


def log_entries(events: DataFrame) -> DataFrame:
    stage = F.pmod("event_id", F.lit(4))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("paper_id"),
        F.when(stage == 0, "download").when(stage == 1, "extract").when(stage == 2, "parse").otherwise("embed").alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("props").alias("message"),
        F.col("ts").alias("created_at"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


SQL = {
    "c_venues": """
        SELECT n_nationkey::BIGINT AS id, n_name AS name,
               CASE n_regionkey % 3 WHEN 0 THEN 'conference' WHEN 1 THEN 'journal' ELSE 'preprint' END AS type,
               'https://venue/' || n_nationkey AS url
        FROM nation""",
    "c_authors": """
        SELECT s_suppkey AS id, '  ' || s_name || ' ' AS name, trim(lower(s_name)) AS name_normalized,
               ['nation ' || s_nationkey] AS affiliations
        FROM supplier""",
    "c_papers": """
        SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderkey AS title, 'by ' || o_custkey AS abstract,
               NULL::VARCHAR AS full_text, c_nationkey::BIGINT AS venue_id, year(o_orderdate)::INTEGER AS year,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN 'arx.' || o_orderkey END AS arxiv_id,
               CASE WHEN o_orderpriority <> '5-LOW' THEN '10/' || o_orderkey END AS doi,
               NULL::VARCHAR AS pdf_url, NULL::VARCHAR AS pdf_path,
               CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'extracted' ELSE 'failed' END AS status,
               0::BIGINT AS citation_count, CASE WHEN o_orderstatus = 'O' THEN 'model-a' END AS embedding_model,
               CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS embedded_at,
               o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "c_paper_authors": """
        SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS position
        FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "c_citations": """
        SELECT DISTINCT l_orderkey AS citing_paper_id, l_partkey AS cited_paper_id FROM lineitem""",
    "c_conversations": """
        SELECT user_id AS id, 'user ' || user_id AS title, min(ts) AS created_at, max(ts) AS updated_at
        FROM events GROUP BY user_id""",
    "c_chats": """
        SELECT DISTINCT conv_id AS id, 'chat ' || conv_id AS title, TIMESTAMP '2024-01-01' AS created_at,
               TIMESTAMP '2024-01-01' AS updated_at
        FROM conversations""",
    "c_queries": """
        SELECT q.conv_id * 1000 + q.turn AS id, q.conv_id AS conversation_id, q.text AS query_text,
               a.text AS response_text, [q.conv_id, q.turn] AS retrieved_ids, 'model-a' AS model_used,
               length(q.text)::INTEGER AS latency_ms, TIMESTAMP '2024-01-01' + to_seconds(q.turn) AS created_at
        FROM conversations q
        LEFT JOIN conversations a
          ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
        WHERE q.role = 'user'""",
    "c_log": """
        SELECT event_id AS id, user_id AS paper_id,
               CASE event_id % 4 WHEN 0 THEN 'download' WHEN 1 THEN 'extract' WHEN 2 THEN 'parse' ELSE 'embed' END AS stage,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
               props AS message, ts AS created_at
        FROM events""",
}
