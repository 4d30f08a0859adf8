"""Suffix arrays of words against comparing all pairs of suffixes; rules on odd texts."""

from __future__ import annotations

import random

import numpy as np

from bibliospark.llm import repetition
from tests.llm.samples import no_documents, odd_documents, odd_rows


def brute(x: list[int]) -> list[int]:
    def common(i: int, j: int) -> int:
        k = 0
        while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        return k

    return [max((common(i, j) for j in range(len(x)) if j != i), default=0) for i in range(len(x))]


def test_longest_repeats():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(25))]
        assert repetition.longest_repeats(np.array(x, dtype=int)).tolist() == brute(x)


def test_many_distinct_words_overflow_no_key():
    x = np.concatenate([np.arange(60_000), np.arange(100, 120)])
    longest = repetition.longest_repeats(x)
    assert longest.max() == 20 and np.count_nonzero(longest) == 40


def test_rules(spark):
    judged = repetition.judge_repetition(odd_documents(spark))
    rows = judged.collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].n_words == 0 and by_id[0].base_failed and not by_id[0].kept
    assert by_id[2].n_words == 0 and by_id[3].n_words == 1
    assert by_id[9].kept and by_id[9].n_words == 6_000
    assert not by_id[11].kept and by_id[11].n_dup_lines == 29 and by_id[11].n_repeat_words == 120
    assert by_id[11].longest_repeat == 116
    assert by_id[4].word_chars == 7


def test_a_long_repeat_fails_alone(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(101))
    rest = " ".join(f"r{rng.random()}" for _ in range(800))
    docs = spark.createDataFrame([(1, f"{passage} {rest} {passage}"), (2, f"{passage} {rest}")], "doc_id int, text string")
    rows = {r.doc_id: r for r in repetition.judge_repetition(docs).collect()}
    assert rows[1].longest_repeat == 101 and not rows[1].kept and not rows[1].base_failed
    assert rows[2].kept


def test_no_documents(spark):
    assert repetition.judge_repetition(no_documents(spark)).count() == 0
