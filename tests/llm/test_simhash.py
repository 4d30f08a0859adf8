"""Fingerprints bit by bit, and components against all pairs."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from bibliospark.llm import simhash
from tests.llm.samples import forest, no_documents, odd_documents, odd_rows


def slow_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for row in odd_rows():
        assert simhash.fingerprint(row[1]) % 2**64 == slow_fingerprint(row[1])


def near_prints(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(2)]
    return np.unique(base[rng.integers(0, 40, n)] ^ flips[0] ^ flips[1])


def test_links_join_what_all_pairs_join(spark):
    prints = near_prints(0, 1_500)
    close = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    wanted = forest(len(prints), close.tolist())
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    for tile in (64, 100_000):
        links = simhash.link_fingerprints(df, tile=tile).collect()
        place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
        assert forest(len(prints), [(place[r.a], place[r.b]) for r in links]) == wanted
    assert len(links) < len(prints)


def test_components_of_odd_documents(spark):
    rows = odd_rows()
    prints = np.array([slow_fingerprint(r[1]) for r in rows], dtype=np.uint64)
    close = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    root = forest(len(rows), close.tolist())
    least = {}
    for r, top in zip(rows, root):
        if r[0] is not None:
            least[top] = min(r[0], least.get(top, r[0]))
    wanted = sorted((r[0] if r[0] is not None else -1, int(p), least[top]) for r, p, top in zip(rows, prints, root))
    found = simhash.near_duplicates(odd_documents(spark).select("doc_id", "text", "fingerprint")).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint % 2**64, r.component_id) for r in found)
    assert got == wanted


def test_one_row_of_each_component_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.one_per_component(docs).collect()
    parts = simhash.near_duplicates(docs).select("component").distinct().count()
    assert len(kept) == parts
    assert simhash.one_per_component(docs).columns == docs.columns


def test_no_documents(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.one_per_component(no_documents(spark)).count() == 0


def test_other_columns_stay_as_they_are(spark):
    names = ("text_hash", "nth", "id", "hash", "_hash", "_n", "component", "first", "least")
    rows = [(i, f"three or more words {i % 2}", *[f"{c}{i}" for c in names]) for i in range(6)]
    rows += [rows[0], (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    kept = simhash.one_per_component(docs, radius=0)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {rows[0], rows[1], rows[-1]}
