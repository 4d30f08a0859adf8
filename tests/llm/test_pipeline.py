"""Each stage of the pipeline against what it should keep, and the whole run."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bibliospark.llm import mixing, secrets, simhash, toxicity
from bibliospark.sources.durable import keep
from tests.llm.samples import forest, no_documents, odd_documents, odd_rows
from tests.llm.test_simhash import slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    """What each stage of the pipeline returned."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def test_columns_and_names(stored):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(df.dtypes == stored[0].dtypes for df in stored[:-1])


def test_toxic_documents_go(spark, stored):
    docs, kept = stored[0], stored[1]
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("rejected").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == rejected


def test_one_of_each_group_stays(stored):
    rows, kept = stored[1].orderBy("doc_id").collect(), stored[2].collect()
    prints = np.array([slow_fingerprint(r.text) for r in rows], dtype=np.uint64)
    root = forest(len(rows), np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.RADIUS).tolist())
    assert sorted(r.doc_id for r in kept) == sorted({rows[i].doc_id for i in root})


def test_secrets_are_masked(stored):
    before = {r.doc_id: r.text for r in stored[2].collect()}
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(stored[2]).collect()}
    for r in stored[3].collect():
        text = before[r.doc_id]
        hidden = [s for s in spans[r.doc_id] if s.verdict != "copied"]
        assert (r.text != text) == bool(hidden) and r.n_chars == len(r.text)
        assert not any(text[s.start : s.end] in r.text for s in hidden)


def test_documents_come_as_often_as_the_mix_takes_them(stored):
    copies = {r.doc_id: r.copies for r in mixing.mix(stored[3]).collect() if r.copies}
    counted = stored[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in counted} == copies


def test_every_copy_is_packed(stored):
    pieces = stored[5].where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    mixed = stored[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in pieces} == {(r.doc_id, r.n) for r in mixed}


def test_sequences_follow_training_time(stored):
    times = {r.doc_id: sum(r.positions) / r.copies for r in mixing.mix(stored[3]).collect() if r.copies == 1}
    rows = [(r.sequence_id, times[r.doc_id]) for r in stored[5].where("piece = 0").collect() if r.doc_id in times]
    assert np.corrcoef(*zip(*rows))[0, 1] > 0.9


def test_run_gives_the_last_stage(spark, stored):
    got = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(got) == rows(stored[5])


def test_odd_documents_pass_every_stage(spark):
    docs = odd_documents(spark)
    told = sorted(str((r[0], *r[2:4], *r[5:])) for r in odd_rows())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, FOLDER), name)
        rows = docs.collect()
        assert docs.dtypes == odd_documents(spark).dtypes
        # every other column is as it came
        assert {str((r[0], *r[2:4], *r[5:])) for r in rows} <= set(told) and len(rows) > 5
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.where("piece = 0").count() == docs.count()


def test_no_documents_pass_every_stage(spark):
    docs = no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0
