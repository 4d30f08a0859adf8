"""Token ids against the tokenizer, and sequences that are gapless and few."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bibliospark.llm import packing
from bibliospark.sources.durable import keep
from tests.llm.samples import no_documents, odd_documents, odd_rows

PATH = public_tokenizers.path(packing.TOKENIZER)


def whole() -> Tokenizer:
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers():
    rng = random.Random(2)
    letters = "abcXYZéÉßüñ 's't're  \n\t\r.,!-_#'\"0123456789½²ªµº中文字🙂İıΣς́ \u0085  <|endoftext|>'ll'VE¡¿«»×÷"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(2_000)]
    texts += ["", "x" * 5_000, "<|endoftext|>", "a <|endoftext|> b", "A<|startoftext|><|endoftext|>e\u0301 <|EndOfText|>"]
    texts += ["\t tab\tand\x0bother\x1cwhite\u2003space \r\n", "İ<|endoftext|>\u0301x", "<|endoftext|" + "y" * 70 + "|>"]
    tokenizer = whole()
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.WordIds(PATH).of(texts) == wanted


def test_memory_of_runs_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_RUNS", 50)
    encoder, tokenizer = packing.WordIds(PATH), whole()
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(40))
        assert encoder.of([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plans_hold_every_piece():
    rng = random.Random(3)
    for top in (5, 300, 4096):
        histogram = {rng.randrange(1, top + 1): rng.randrange(1, 400) for _ in range(120)} | {4096: 3}
        plan = packing.plan(histogram)
        held: dict[int, int] = {}
        for lengths, n in plan:
            assert n > 0 and sum(lengths) <= 4096
            for k in lengths:
                held[k] = held.get(k, 0) + n
        assert held == histogram
        alone = packing.best_fit(list(histogram), list(histogram.values()), 4096)
        assert sum(n for _, n in plan) <= sum(n for _, n in alone)


def test_patterns_fit_a_histogram_made_of_them():
    """Three kinds of sequences in known numbers come back as they are."""
    made = {(3000, 1096): 50, (2000, 2000, 96): 30, (4000, 96): 20}
    histogram: dict[int, int] = {}
    for lengths, n in made.items():
        for k in lengths:
            histogram[k] = histogram.get(k, 0) + n
    assert sum(n for _, n in packing.plan(histogram)) == 100


def test_odd_documents(spark):
    rows = packing.pack_documents(odd_documents(spark), PATH).collect()
    tokenizer = whole()
    wanted = []
    for r in odd_rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            wanted.append((r[0], piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(wanted, key=key)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= sum(ends.values()) // 4096 + 2


def test_no_documents(spark):
    assert packing.pack_documents(no_documents(spark), PATH).count() == 0


def test_repeated_rows_fill_no_bucket_alone(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(4_000)] + [(1, "one hot row")] * 2_000
    sizes = []
    plain = packing.number_within

    def counted(df, key, tie, name, n):
        spread = df.groupBy(F.pmod(F.xxhash64(*tie), F.lit(8)).alias("bucket")).count().collect()
        sizes.extend(r["count"] for r in spread)
        return plain(df, key, tie, name, n, 750)

    monkeypatch.setattr(packing, "number_within", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack_documents(docs, PATH, sequence=64).collect()
    assert len(got) == 6_000 and len(sizes) == 8 and max(sizes) < 1_000
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 64


def test_sequences_follow_the_order_of_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 40))) for i in range(3_000)] + [(7, "word")] * 1_500 + [(None, None)] * 3
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, place int").repartition(5)
    got = packing.pack_documents(docs, PATH, sequence=64, order=[F.col("place")]).collect()
    plain = packing.pack_documents(docs, PATH, sequence=64).collect()
    key = lambda r: str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    assert sorted(map(key, got)) == sorted(map(key, plain)) and got[0].asDict().keys() == plain[0].asDict().keys()
    ends: dict[int, int] = {}
    held: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        held.setdefault(r.sequence_id, []).append(r.doc_id)
    assert max(ends.values()) <= 64 and sorted(ends) == list(range(len(ends)))
    # a part of the order is packed by itself: at most one sequence more for each
    assert len(ends) <= len({r.sequence_id for r in plain}) + packing.SEGMENTS
    first = [min(i for i in own if i not in (7, None)) for own in held.values() if any(i not in (7, None) for i in own)]
    assert np.corrcoef(range(len(first)), first)[0, 1] > 0.95


def test_order_of_stored_rows(spark):
    docs = keep(spark.range(5_000).withColumn("_metadata", F.lit("own")).orderBy(F.desc("id")), "test-sorted")
    rows = docs.orderBy(*packing.stored_order(docs)).collect()
    assert [r.id for r in rows] == list(range(4_999, -1, -1)) and rows[0]._metadata == "own"
    assert packing.stored_order(spark.createDataFrame([(1, "a")], "doc_id long, text string")) is None
    assert packing.stored_order(no_documents(spark)) is None or packing.stored_order(keep(no_documents(spark), "test-none"))
