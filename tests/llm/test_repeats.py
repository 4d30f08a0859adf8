"""Removal of repeated byte strings against counting every window."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from bibliospark.llm.repeats import parse_texts, remove_repeats, window_classes
from tests.llm.samples import no_documents, odd_documents, odd_rows


def brute(texts: list[bytes], length: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))).tolist()
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), list(zip(edges[::2], edges[1::2])), kept))
    return out


def order(row: tuple) -> tuple:
    return row[0] is None, row[0] or 0, *row[1:]


def found(df) -> list[tuple]:
    rows = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()]
    return sorted(rows, key=order)


@pytest.mark.parametrize("most_phrases", [8_000, 1])
def test_agrees_with_counting_windows(spark, most_phrases):
    rows = odd_rows()
    texts = [(r[1] or "").encode() for r in rows]
    wanted = [(r[0], *b) for r, b in zip(rows, brute(texts, 200))]
    got = found(remove_repeats(odd_documents(spark), dictionary_bytes=5_000, most_phrases=most_phrases))
    assert got == sorted(wanted, key=order)


def test_short_strings_and_runs_of_one_letter(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 120))) for _ in range(40)]
    texts += ["a" * 60, "a" * 61, "abcabc" * 20, "é" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = [(i, *b) for i, b in enumerate(brute([t.encode() for t in texts], 24))]
    assert found(remove_repeats(docs, length=24, trigger=8)) == wanted
    assert found(remove_repeats(docs, length=24, trigger=8, most_phrases=1)) == wanted


def test_nothing_in_nothing_out(spark):
    assert remove_repeats(no_documents(spark)).count() == 0


def test_every_window_has_one_phrase():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc", k=rng.randrange(0, 900))) for _ in range(50)]
    covered = Counter()
    for text, start, n, _, _ in parse_texts(texts, 50, 16):
        for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()):
            covered.update((t, p) for p in range(s, s + k))
    assert covered == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 49))


def test_window_classes_name_equal_windows_in_order():
    rng = random.Random(2)
    data = bytes(rng.choices(b"ab", k=400))
    starts = np.arange(400 - 30)
    named = window_classes(np.frombuffer(data, dtype=np.uint8), starts, 30)
    windows = [data[s : s + 30] for s in starts]
    order = {w: i for i, w in enumerate(sorted(set(windows)))}
    assert named.tolist() == [order[w] for w in windows]


def test_texts_of_one_id_whose_short_hashes_agree(spark):
    passage = "".join(f"passage {i} of many; " for i in range(20))
    ids = spark.range(150_000)
    with_it = ids.select(F.concat(F.lit(passage), F.col("id").cast("string")).alias("a")).withColumn("h", F.hash("a"))
    other = F.concat(*(F.md5(F.concat_ws("-", "id", F.lit(k))) for k in range(15)))
    without = ids.select(other.alias("b")).withColumn("h", F.hash("b"))
    pair = with_it.join(without, "h").orderBy("a", "b").first()
    assert pair is not None
    texts = [pair.a, pair.b, passage]
    docs = spark.createDataFrame(list(zip((1, 1, 2), texts)), "doc_id long, text string")
    got = [(r.n_bytes, [(a, b) for a, b in r.spans], bytes(r.kept)) for r in remove_repeats(docs).collect()]
    assert sorted(got) == sorted(brute([t.encode() for t in texts], 200))


def test_many_copies_of_one_row(spark):
    text = "".join(f"sentence {i} of the text that is copied; " for i in range(40))
    rows = [(1, text)] * 300 + [(i, f"{i} alone " * 3) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeats(docs).collect()
    assert len(got) == 900
    assert all((r.n_bytes, len(r.kept)) == (len(text), 0) for r in got if r.n_bytes > 1_000)
    assert all(len(r.kept) == r.n_bytes for r in got if r.n_bytes < 1_000)
