"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.llm import (
    maxscore,
    mixing,
    negatives,
    packing,
    rangemax,
    refinement,
    repeats,
    repetition,
    secrets,
    sharding,
    simhash,
    toxicity,
    warc,
)
from bibliospark.llm.common import table
from bibliospark.sources.durable import keep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


@query("op1_repeated_strings")
def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op2_repeat_rules",
    r"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), places AS (
        SELECT r, i, len(words) AS n,
               CASE WHEN i + 2 <= len(words) THEN array_to_string(words[i:i + 2], ' ') END AS g3,
               CASE WHEN i + 5 <= len(words) THEN array_to_string(words[i:i + 5], ' ') END AS g6,
               CASE WHEN i + 100 <= len(words) THEN md5(array_to_string(words[i:i + 100], ' ')) END AS g101
        FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM texts)
    ), marked AS (
        SELECT r, i,
               g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 AS r3,
               g6 IS NOT NULL AND count(*) OVER (PARTITION BY r, g6) > 1 AS r6,
               g101 IS NOT NULL AND count(*) OVER (PARTITION BY r, g101) > 1 AS r101
        FROM places
    ), spread AS (
        SELECT r, r101,
               bool_or(r3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
               bool_or(r6) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c6
        FROM marked
    ), counted AS (
        SELECT r, count(*) FILTER (c3) AS n3, count(*) FILTER (c6) AS n6, bool_or(r101) AS too_long
        FROM spread GROUP BY r
    ), features AS (
        SELECT doc_id, len(words)::BIGINT AS n_words,
               length(array_to_string(words, ''))::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               coalesce(n3, 0)::BIGINT AS n_repeat_words,
               coalesce(n6, 0)::BIGINT AS n_covered_words,
               coalesce(too_long, false) AS too_long
        FROM texts LEFT JOIN counted USING (r)
    ), judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
           NOT base_failed AND NOT (100 * n_covered_words > 40 * n_words) AND NOT too_long AS kept
    FROM judged
    """,
)
def op2_repeat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judge_repetition(docs).drop("longest_repeat", "repetitive")


@query("op3_simhash_tiles")
def op3_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prints = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", prints.alias("fingerprint"), "component_id")


@query(
    "op4_capture_index",
    r"""
    WITH keyed AS (
        SELECT page_id, coalesce(html, '') AS payload,
               regexp_replace(regexp_replace(coalesce(url, ''), '^[a-zA-Z]+://', ''), '#.*$', '') AS rest
        FROM pages
    ), parts AS (
        SELECT *, regexp_extract(rest, '^[^/?]*') AS host, sha1(payload) AS hex FROM keyed
    ), named AS (
        SELECT page_id, payload, octet_length(encode(payload))::BIGINT AS payload_bytes,
               array_to_string(list_reverse(string_split(
                   regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', ''), '.')), ',')
               || ')' || CASE WHEN length(rest) > length(host) THEN substr(rest, length(host) + 1) ELSE '/' END AS urlkey,
               list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER) AS parts5,
               max(page_id) OVER (PARTITION BY payload) AS first_id
        FROM parts
    )
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((parts5[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
           urlkey, row_number() OVER (ORDER BY urlkey, page_id) - 1 AS position
    FROM named
    """,
)
def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "position"
    )


@query("op5_pattern_packing")
def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


@query("op6_curriculum_mix")
def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("row", F.monotonically_increasing_id())
    mixed = keep(mixing.mix(docs, keep_cols=("row",)), "mixed")
    places = mixing.in_training_order(mixed.select("doc_id", "source", "row", "positions"))
    first = places.groupBy("row").agg(F.min("position").alias("first_position"), F.min("place").alias("first_place"))
    whole = mixed.join(first, "row", "left")
    return whole.select("doc_id", "size", "source_size", "target", "taken", "first_position", "first_place")


@query("op7_severity_grades")
def op7_severity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.grade_documents(docs.select("doc_id", "text"), labels)


@query("op8_differencing_shards")
def op8_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op9_maxscore",
    """
    WITH terms AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS t FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.t, c.t)::BIGINT AS score
        FROM terms q JOIN terms c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
    ) WHERE rank <= 5
    """,
)
def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


@query("op10_secret_ownership")
def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secrets.digest(secrets.scan_secrets(docs))


@query(
    "op11_angular_negatives",
    """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS t
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS alike, list_inner_product(a.t, o.t)::BIGINT AS score
        FROM rows a JOIN rows o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
        SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    ) WHERE rank <= 3
    """,
)
def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


@query(
    "op12_range_maxima",
    r"""
    WITH words AS (
        SELECT doc_id, r, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)
    ), lengths AS (
        SELECT doc_id, r, count(*) AS n FROM words GROUP BY ALL
    ), totals AS (
        SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
    ), held AS (
        SELECT r, term, count(*) AS tf FROM words GROUP BY ALL
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM held, totals GROUP BY term
    ), asked AS (
        SELECT item_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), scored AS (
        SELECT item_id, r, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (r), totals
        GROUP BY item_id, r, doc_id
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 20
    """,
)
def op12_range_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangemax.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_refined_copies",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op13_refined_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return refinement.find_copies(docs, every_digest=True)
