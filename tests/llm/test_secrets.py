"""Base spans by the plain patterns, and verdicts by counting owners in Python."""

from __future__ import annotations

import hashlib
import re

from bibliospark.llm import secrets
from tests.llm.samples import no_documents, odd_documents, odd_rows

LIVE = "Zx8kQ2mVb7Lw4Tn9Rp3Yc6Hd"


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    assign = re.compile(secrets.ASSIGN.pattern, re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_digest_of_odd_documents(spark):
    rows = secrets.digest(secrets.scan_secrets(odd_documents(spark))).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}
    for r in rows:
        if r.doc_id is None:
            continue
        base = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_owners_tell_copies_from_live_secrets(spark):
    rows = [(i, f"see {LIVE} here, says {i}", "en", f"owner{i}") for i in range(3)]
    rows += [(10, f"mine {LIVE[::-1]} é token={LIVE[3:]}", "en", "solo"), (11, f"mine {LIVE[::-1]}", "de", "solo")]
    rows += [(12, None, None, None), (13, "", "en", "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert all(found[i] == [] for i in (0, 1, 2, 12, 13))  # a token that three owners copy is no secret
    (first, second) = found[10]
    assert (first.verdict, first.owners, first.repositories) == ("live", 1, 2)
    assert (second.kind, second.verdict) == (0, "live")
    assert [s.verdict for s in found[11]] == ["live"]
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[10] == "mine [SECRET] é [SECRET]" and masked[0] == rows[0][1] and masked[12] is None


def test_a_document_copied_to_another_source_keeps_its_secret(spark):
    other = "Qa7Zt3Xw9Ke5Vb1Nm8Ry4Lp6"
    rows = [(i, f"mine {LIVE} and token={LIVE[2:]}", "en", f"owner{i}") for i in range(2)]
    rows += [(5, f"mine {LIVE}, edited", "en", "owner0")]  # a third text, but no third owner
    rows += [(10 + i, f"text {i} {other}", "en", f"owner{i % 2}") for i in range(4)]
    rows += [(20 + i, f"example {i} password={other[::-1]}", "en", f"owner{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert [[(s.kind, s.owners, s.verdict) for s in found[i]] for i in (0, 1)] == [[(3, 1, "live"), (0, 1, "live")]] * 2
    assert all([(s.owners, s.verdict) for s in found[10 + i]] == [(2, "live")] for i in range(4))
    assert all([(s.owners, s.repositories, s.verdict) for s in found[20 + i]] == [(3, 3, "copied")] for i in range(3))
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[0] == masked[1] == "mine [SECRET] and [SECRET]" and masked[20] == rows[-3][1]


def test_a_document_mirrored_everywhere_keeps_its_secret(spark):
    rows = [(i, f"mine {LIVE} and token={LIVE[2:]}", "en", f"owner{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdicts = [[(s.owners, s.verdict) for s in r.spans] for r in secrets.scan_secrets(docs).collect()]
    assert verdicts == [[(1, "live"), (1, "live")]] * 9
    assert {r.text for r in secrets.redact(docs).collect()} == {"mine [SECRET] and [SECRET]"}


def test_a_value_in_a_third_of_all_rows(spark):
    rows = [(i, f"text {i} token={LIVE}" if i % 3 == 0 else f"text {i}", "en", f"owner{i % 7}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert len(found) == 900
    assert all([(s.owners, s.verdict) for s in found[i]] == ([(7, "copied")] if i % 3 == 0 else []) for i in found)


def test_overlapping_spans_become_one_mask(spark):
    text = 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b'
    docs = spark.createDataFrame([(1, text, "en", "s", 9)], "doc_id long, text string, lang string, source string, spans int")
    (row,) = secrets.redact(docs).collect()
    assert row.text == 'a [SECRET]" b' and row.spans == 9


def test_no_documents(spark):
    assert secrets.scan_secrets(no_documents(spark)).count() == 0
    assert secrets.redact(no_documents(spark)).count() == 0
