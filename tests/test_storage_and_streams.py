from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from bibliospark.schemas import TABLES
from bibliospark.sources import tables
from bibliospark.sources.durable import keep, shared_folder
from bibliospark.streaming import feeds
from tests.samples import NOW, at, papers


def test_declaring_tables_twice_keeps_their_rows(spark, tmp_path):
    root = str(tmp_path)
    tables.declare_tables(spark, root)
    assert {n: tables.read_table(spark, root, n).count() for n in TABLES} == dict.fromkeys(TABLES, 0)
    papers(spark, 1, 2).write.mode("append").parquet(f"{root}/papers")
    tables.declare_tables(spark, root)
    assert tables.read_table(spark, root, "papers").count() == 2


def test_snapshot_is_never_overwritten(spark, tmp_path):
    tables.write_snapshot(papers(spark, 1), str(tmp_path), "papers")
    with pytest.raises(AnalysisException):
        tables.write_snapshot(papers(spark, 2), str(tmp_path), "papers")
    assert [r.id for r in tables.read_table(spark, str(tmp_path), "papers").collect()] == [1]


def test_kept_rows_lie_in_the_shared_folder(spark):
    kept = keep(spark.range(5), "five")
    assert all(f.startswith(f"file://{shared_folder(spark)}/bibliospark/five-") for f in kept.inputFiles())
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("every", [1, 2, 20])
def test_activity_over_several_runs(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(feeds, "COMPACT_EVERY", every)
    schema = "conversation_id bigint, created_at timestamp_ntz"
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.watch_conversations(stream, out, state).awaitTermination()
        return {r.conversation_id: r.updated_at for r in feeds.read_activity(spark, out).collect()}

    assert run((1, at(3)), (1, at(5)), (2, at(1)), (None, at(9))) == {1: at(5), 2: at(1)}
    assert run((1, at(4)), (3, at(2))) == {1: at(5), 2: at(1), 3: at(2)}
    assert run((2, at(8))) == {1: at(5), 2: at(8), 3: at(2)}
    # a batch without a mark is not there yet
    stray = spark.createDataFrame([(1, at(59))], "conversation_id bigint, updated_at timestamp_ntz")
    stray.write.parquet(f"{out}/changes/batch=3")
    assert {r.conversation_id: r.updated_at for r in feeds.read_activity(spark, out).collect()}[1] == at(5)


def test_log_stream_numbers_on_and_splits_off_rejects(spark, tmp_path):
    schema = "seq bigint, paper_id bigint, stage string, status string"
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.ingest_log(stream, papers(spark, 1, 2), out, state, 10, NOW).awaitTermination()
        rows = feeds.read_log(spark, out).collect()
        return sorted((r.id, r.paper_id) for r in rows)

    assert run((1, 1, "parse", "success"), (2, 2, "print", "success"), (3, 2, "embed", "failed")) == [(11, 1), (12, 2)]
    assert run((1, 9, "parse", "success")) == [(11, 1), (12, 2)]
    assert run((1, 1, "embed", "failed")) == [(11, 1), (12, 2), (13, 1)]
    rejected = feeds.read_log(spark, out, "rejected").collect()
    assert sorted(r.reason for r in rejected) == ["check", "foreign_key"]


def test_replayed_log_batch_gives_the_same_ids(spark, tmp_path):
    """Losing the commit of a batch makes Spark run it again."""
    schema = "seq bigint, paper_id bigint, stage string, status string"
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = [(i, 1, "parse", "success") for i in range(20)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.ingest_log(stream, papers(spark, 1), out, state, 0, NOW).awaitTermination()
        return sorted(r.id for r in feeds.read_log(spark, out).collect())

    first = run()
    (tmp_path / "state" / "commits" / "0").unlink()
    (tmp_path / "state" / "commits" / ".0.crc").unlink(missing_ok=True)
    assert run() == first == list(range(1, 21))


def test_plans_use_no_python_rows(spark):
    """Outside retrieval, nothing leaves the JVM."""
    from bibliospark.plans import reads

    plan = reads.papers_with_authors_and_counts(spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
