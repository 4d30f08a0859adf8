"""Feeds with state: counts by window, and log entries that come before their paper."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest

from bibliospark.operators.ingest import append_log
from bibliospark.streaming import feeds
from tests.samples import NOW, papers

DAY = datetime(2024, 1, 1)


def minute(n: int) -> datetime:
    return DAY + timedelta(minutes=n)


class Source:
    """A folder of files that a stream reads, one more each time."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        self.spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self.stream()

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_counts_by_window_with_late_rows(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "conversation_id bigint, created_at timestamp_ntz")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    assert feeds.read_counts(spark, out).count() == 0 and feeds.read_activity(spark, out).count() == 0

    def run(*rows):
        query = feeds.count_activity(source.add(*rows), out, state, "1 hour")
        query.awaitTermination()
        counts = {(r.conversation_id, r.window_start): (r.n_queries, r.last_at) for r in feeds.read_counts(spark, out).collect()}
        progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        return counts, progress

    def plain(rows):
        hours = Counter((c, DAY + timedelta(hours=(t - DAY) // timedelta(hours=1))) for c, t in rows)
        newest = {k: max(t for c, t in rows if (c, DAY + timedelta(hours=(t - DAY) // timedelta(hours=1))) == k) for k in hours}
        return {k: (n, newest[k]) for k, n in hours.items()}

    first = [(1, minute(5)), (1, minute(50)), (2, minute(70)), (None, minute(3)), (1, None)]
    told = [r for r in first if None not in r]
    assert run(*first)[0] == plain(told)
    # 20 minutes late, inside the hour: counted
    second = [(1, minute(40)), (2, minute(110))]
    assert run(*second)[0] == plain(told + second)
    # far ahead: the old windows leave the state, their counts stay
    third = [(3, minute(60 * 30))]
    counts, progress = run(*third)
    assert counts == plain(told + second + third)
    assert progress[-1]["numRowsTotal"] == 1
    # a day late: dropped and told; on time: counted
    fourth = [(3, minute(60 * 30 + 1))]
    counts, progress = run((1, minute(6)), *fourth)
    assert counts == plain(told + second + third + fourth)
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 1
    assert progress[-1]["numRowsTotal"] == 1


ENTRY = "seq bigint, paper_id bigint, stage string, status string, created_at timestamp_ntz"


def test_entries_before_their_paper_end_as_in_one_batch(spark, tmp_path):
    entries = Source(spark, tmp_path / "entries", ENTRY)
    arrivals = Source(spark, tmp_path / "papers", "id bigint, created_at timestamp_ntz")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    stored = papers(spark, 1, 2)
    assert feeds.read_log(spark, out).count() == 0 and feeds.read_log(spark, out, "rejected").count() == 0
    told = []

    def run(rows, came):
        told.extend(rows)
        query = feeds.settle_log(
            entries.add(*rows), arrivals.add(*came), stored, out, state, "60 minutes", "60 minutes", "10 minutes", 10, NOW
        )
        query.awaitTermination()
        accepted = feeds.read_log(spark, out).collect()
        rejected = feeds.read_log(spark, out, "rejected").collect()
        assert sorted(r.id for r in accepted) == list(range(11, 11 + len(accepted)))
        state_rows = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        return Counter(r.paper_id for r in accepted), {(r.seq, r.reason) for r in rejected}, state_rows

    # 1 is stored, 5 comes later, 9 never does, 7 came just before; no paper is no fault, a bad stage is one
    first = [
        (1, 1, "parse", "success", minute(10)),
        (2, 5, "parse", "success", minute(11)),
        (3, 9, "embed", "failed", minute(12)),
        (4, None, "parse", "success", minute(13)),
        (5, 7, "parse", "success", minute(14)),
        (6, 2, "print", "success", minute(15)),
    ]
    accepted, rejected, _ = run(first, [(7, minute(1))])
    assert accepted == Counter([1, None, 7]) and rejected == {(6, "check")}
    accepted, rejected, _ = run([(7, 5, "embed", "success", minute(20))], [(5, minute(40))])
    assert accepted == Counter([1, None, 7, 5, 5]) and rejected == {(6, "check")}
    # time goes on: the entry about 9 has waited long enough
    accepted, rejected, state_rows = run([(8, 6, "parse", "success", minute(600))], [(6, minute(600)), (8, minute(601))])
    assert accepted == Counter([1, None, 7, 5, 5, 6]) and rejected == {(6, "check"), (3, "foreign_key")}
    # what is over left the state: the last entry and two papers stay
    assert state_rows[-1] <= 3
    # one batch, with all papers there, gives the same
    batch = spark.createDataFrame(told, ENTRY)
    whole = append_log(batch, papers(spark, 1, 2, 5, 6, 7, 8), 10, NOW)
    assert Counter(r.paper_id for r in whole.accepted.collect()) == accepted
    assert {(r.seq, r.reason) for r in whole.rejected.collect()} == rejected
    # a restart without new input repeats nothing
    again = feeds.settle_log(entries.stream(), arrivals.stream(), stored, out, state, "60 minutes", "60 minutes", "10 minutes", 10, NOW)
    again.awaitTermination()
    assert Counter(r.paper_id for r in feeds.read_log(spark, out).collect()) == accepted
