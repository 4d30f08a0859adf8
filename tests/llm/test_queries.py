"""Registered queries: those with SQL against it, all others for their columns and whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from bibliospark.llm.queries import ORACLE, QUERIES
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3": "doc_id fingerprint component_id",
    "op5": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6": "doc_id size source_size target taken",
    "op7": "doc_id severity grade rejected",
    "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(rows.columns)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(r.doc_id for r in rows.select("doc_id").distinct().collect()) == sorted(
        r.doc_id for r in docs.select("doc_id").collect()
    )


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
