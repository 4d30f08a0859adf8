"""Quality rules on repetition, from each text's suffix array of words.

The words of a text are numbered, its suffixes are sorted by prefix doubling,
and the longest common prefix of neighbours comes from the ranks of the
doubling steps. Sorted neighbours with a common prefix of at least ``l`` words
form the LCP intervals of repeated word strings; the innermost interval of a
suffix gives the longest string that starts there and occurs again, and these
strings, one per start, cover exactly what all maximal repeats cover. A text is
rejected if they cover too much of it or if one of them is too long.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import WORD, replace_column

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Base rules: fewest words, and most words in repeated windows, in percent.
MIN_WORDS = 50
WINDOW = 3
MAX_REPEAT_PERCENT = 50
#: Repeats of fewer words than this are ordinary phrases.
MIN_REPEAT = 6
#: Most words within repeats, in percent, and most words of one repeat.
MAX_COVERED_PERCENT = 40
MAX_LONGEST = 100

FEATURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_covered_words",
    "longest_repeat",
)


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each start the length of the longest string there that starts elsewhere too."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    # keys tell strings of 1, 2, 4, ... words apart; 0 stands for the end of the text
    keys = [symbols.astype(np.int64) + 1]
    size, width = int(keys[0].max()) + 1, 1
    while True:
        shifted = np.zeros(n, dtype=np.int64)
        shifted[: max(0, n - width)] = keys[-1][width:]
        key = keys[-1] * size + shifted
        size, width = size * size, 2 * width
        if width == 2 and size < 1 << 31:
            keys.append(key)  # small enough to be joined once more before sorting
            continue
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps + 1
        keys.append(rank)
        size = int(steps[-1]) + 2
        if size == n + 1:
            break
    # order is the suffix array now; lift neighbours by ever smaller powers of two
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(keys) - 2, -1, -1):
        at_a, at_b = a + common, b + common
        inside = np.maximum(at_a, at_b) < n
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = keys[level][at_a[inside]] == keys[level][at_b[inside]]
        common[same] += 1 << level
    out = np.zeros(n, dtype=np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """How many of ``n`` places the spans cover together."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str | None, min_repeat: int = MIN_REPEAT) -> dict[str, int]:
    """The features of one text; a null or empty text has zeros."""
    words = WORDS.findall(text) if text else []
    if not words:
        return dict.fromkeys(FEATURES, 0) | {"n_symbols": 0}
    numbers: dict[str, int] = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    repeat = longest_repeats(symbols)
    windows = np.flatnonzero(repeat >= WINDOW)
    long = np.flatnonzero(repeat >= min_repeat)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": covered(windows, np.full(len(windows), WINDOW), len(words)),
        "n_covered_words": covered(long, repeat[long], len(words)),
        "longest_repeat": int(repeat.max()),
    }


def measure_repetition(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``docs`` without the text and with its features; other columns that clash are dropped.

    Each text is measured whole, by itself, in one pass and without a shuffle.
    """
    clash = [c for c in FEATURES if c in docs.columns and c != text_col]
    kind = "struct<" + ",".join(f"{c}:bigint" for c in FEATURES) + ">"
    arrow = pa.struct([(c, pa.int64()) for c in FEATURES])
    measured = replace_column(
        docs.drop(*clash), text_col, "_features", kind, lambda texts: [measure(t, min_repeat) for t in texts], arrow
    )
    return measured.select("*", "_features.*").drop("_features")


def judge_repetition(
    docs: DataFrame,
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """:func:`measure_repetition` with ``base_failed``, ``repetitive`` and ``kept``.

    A null or empty text fails the base rules. Repeated rows are judged alike.
    """
    n = F.col("n_words")
    base_failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    repetitive = (100 * F.col("n_covered_words") > max_covered_percent * n) | (
        F.col("longest_repeat") > max_longest
    )
    measured = measure_repetition(docs, text_col, min_repeat)
    return measured.withColumns(
        {"base_failed": base_failed, "repetitive": repetitive, "kept": ~base_failed & ~repetitive}
    )
