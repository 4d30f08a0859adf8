"""Archives round trip, the merge against sorting, and odd pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

from bibliospark.llm import warc
from bibliospark.sources.durable import keep


def rows_of():
    rng = random.Random(1)
    pages = [
        (1, "http://www.A.example.com:80/x?q=1#top", "<p>é</p>"),
        (2, "https://a.example.com/x?q=1", "<p>é</p>"),
        (3, None, None),
        (4, "bad url \r\nX: y", ""),
        (5, "http://b.example.com", "line\r\n\r\nWARC/1.1\r\n\r\n"),
        (6, "http://b.example.com", "x" * 300_000),
        (6, "http://b.example.com", "x" * 300_000),
        (None, "http://c.example.com/", "lone"),
        (None, "http://c.example.com/", "shared"),
        (9, "http://c.example.com/", "shared"),
    ]
    pages += [(10 + i, f"http://h{rng.randrange(5)}.example.com/{rng.randrange(9)}", f"p{rng.randrange(20)}") for i in range(200)]
    return [(*p, 7, "z") for p in pages]


SCHEMA = "page_id long, url string, html string, position int, digest string"


def test_pages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 20)
    rows = rows_of()
    index = warc.archive_and_index(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    largest: dict[str, int | None] = {}
    for page, _, html, *_ in rows:
        old = largest.get(html or "")
        largest[html or ""] = page if old is None else max(old, page if page is not None else old)
    wanted = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        first = largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = page == first
        wanted.append((page, len(data), digest, "response" if same else "revisit", None if same else first))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    ordered = sorted(index, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(rows)))
    keys = [warc.order_of(r.asDict()) for r in ordered]
    assert keys == sorted(keys)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(rows_of(), SCHEMA)
    kinds = {(r.payload_bytes, r.record_type) for r in warc.archive_and_index(pages, min_bytes=5).collect()}
    assert not any(n < 5 and kind == "revisit" for n, kind in kinds)
    assert any(kind == "revisit" for _, kind in kinds)


def test_records_are_where_the_index_says(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(rows_of(), SCHEMA), f"{tmp_path}/a")
    for r in keep(warc.read_runs(spark, f"{tmp_path}/a"), "runs").collect():
        with gzip.open(r.archive.removeprefix("file:")) as f:
            data = f.read()[r.offset : r.offset + r.length]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (10, 100, 1_000))
    warc.write_archives(spark.createDataFrame(rows_of(), SCHEMA).coalesce(1), f"{tmp_path}/a")
    sizes: dict[str, list] = {}
    found = keep(warc.read_runs(spark, f"{tmp_path}/a"), "runs").collect()
    for r in found:
        sizes.setdefault(r.archive, []).append(r.payload_bytes)
    assert len(found) == len(rows_of())
    assert all(sum(s) <= 1_000 or len(s) == 1 for s in sizes.values())
    assert max(map(len, sizes.values())) > 1


def test_a_payload_that_a_third_of_all_pages_share(spark, monkeypatch):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 50)
    rows = [(i, "http://one.example.com/", "" if i % 3 == 0 else f"p{i}", 7, "z") for i in range(900)]
    index = warc.archive_and_index(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.record_type, r.refers_to) for r in index if r.page_id % 3 == 0 and r.page_id != 897} == {("revisit", 897)}
    assert [r.page_id for r in sorted(index, key=lambda r: r.position)] == list(range(900))


def test_runs_read_in_pieces():
    entries = [{"urlkey": k, "captured": "t", "page_id": None, "archive": a, "offset": i} for i, (k, a) in enumerate(["cx", "dy", "ax", "by", "bx"])]
    pieces = warc.sorted_runs(entries)
    assert sorted(len(p) for p in pieces) == [1, 1, 1, 2]
    assert [e["urlkey"] for _, e in warc.loser_tree_merge(pieces)] == ["a", "b", "b", "c", "d"]


def test_a_changed_payload_is_found():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nWARC-Date: d\r\n"
    body = "HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\ny"
    digest = base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    record = f"{head}WARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    with pytest.raises(ValueError):
        warc.entries_of("a", record.encode())


def test_loser_tree_merges():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i, j) for j in range(rng.randrange(30))) for i in range(k)]
        assert list(warc.loser_tree_merge(runs)) == sorted(x for r in runs for x in r)


def test_no_pages(spark):
    assert warc.archive_and_index(spark.createDataFrame([], SCHEMA)).count() == 0
