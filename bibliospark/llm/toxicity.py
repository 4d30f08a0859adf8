"""Severity of toxicity by cumulative-link ordinal regression on sparse features.

One weight per feature is shared by all thresholds:
``P(grade <= k) = logistic(threshold_k - score)``, with ordered thresholds.
The output is the expected grade, the sum of ``P(grade > k)``. Features are the
words of a text and the first letters of its words, hashed, each with the
logarithm of its count; those that tell grades apart are kept.

The fit uses a bounded sample of labelled rows on the driver, which gets of
their features only those that tell grades apart; these are chosen from counts
that tasks make. Texts are scored where they lie.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import given_back, replace_column, set_aside
from bibliospark.sources.durable import keep

LETTERS = re.compile(r"[^\W\d_]+")
#: Features are hashed into this many slots.
SLOTS = 1 << 18
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7)
#: At most this many labelled rows are used for the fit, those with the smallest hash of their id.
MAX_LABELLED = 6_000
#: Of features that tell toxic from other rows beyond chance, at most this many get a weight.
MAX_FEATURES = 2_000
#: A text is rejected if it is more likely toxic than not.
MIN_PROBABILITY = 0.5
REMEMBERED_WORDS = 200_000


class Features:
    """Feature slots of texts with their counts; what a word gives is remembered, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        names = [f"w {word}", *(f"p {word[:n]}" for n in PREFIXES if len(word) > n)]
        return tuple(zlib.crc32(n.encode()) % SLOTS for n in names)

    def of(self, text: str | None) -> dict[int, int]:
        if not text:
            return {}
        counts = Counter(LETTERS.findall(text.lower()))
        if len(self.known) + len(counts) > REMEMBERED_WORDS:
            self.known = {}
        slots: dict[int, int] = {}
        for word, n in counts.items():
            found = self.known.get(word)
            if found is None:
                found = self.of_word(word)
                if len(word) <= 40:
                    self.known[word] = found
            for slot in found:
                slots[slot] = slots.get(slot, 0) + n
        return slots


@dataclass
class Severity:
    """A fitted model: features with a weight, and the ordered thresholds."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def screen(rows: np.ndarray, slots: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The slots whose presence goes with toxicity, or its absence, beyond chance."""
    with_it = np.bincount(slots, minlength=SLOTS).astype(float)
    both = np.bincount(slots[toxic[rows]], minlength=SLOTS).astype(float)
    return telling(with_it, both, len(toxic), int(toxic.sum()))


def telling(with_it: np.ndarray, both: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """``screen`` from how many of ``n`` rows, and of the toxic ones, have each slot.

    The log-likelihood ratio of the two-by-two table must exceed what the best
    of as many useless features would reach.
    """
    ratio = np.zeros(SLOTS)
    cells = (
        (both, with_it * n_toxic / n),
        (with_it - both, with_it * (n - n_toxic) / n),
        (n_toxic - both, (n - with_it) * n_toxic / n),
        (n - with_it - n_toxic + both, (n - with_it) * (n - n_toxic) / n),
    )
    for seen, expected in cells:
        some = (seen > 0) & (expected > 0)
        ratio[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    limit = 2 * np.log(max(2, np.count_nonzero(with_it))) + 4
    best = np.argsort(-ratio, kind="stable")[:MAX_FEATURES]
    return np.sort(best[ratio[best] > limit])


@dataclass
class Sample:
    """Labelled rows: each feature of each row, and whether the row is toxic.

    Where the slots that tell toxic rows from others were ``chosen`` before, the others are not there.
    """

    rows: np.ndarray
    slots: np.ndarray
    values: np.ndarray
    toxic: np.ndarray
    chosen: np.ndarray | None = None

    def screened(self, toxic: np.ndarray) -> np.ndarray:
        return screen(self.rows, self.slots, toxic) if self.chosen is None else self.chosen

    @classmethod
    def of(cls, sizes: np.ndarray, slots: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> Sample:
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return cls(rows, slots.astype(np.int32), np.log1p(counts.astype(np.float32)), toxic.astype(bool))


def fit(sample: Sample, grades: np.ndarray, steps: int = 300, penalty: float = 0.1) -> Severity:
    """Maximum likelihood with an L2 penalty, by Adam on the whole sample.

    ``grades`` are 0 to K. Grades that do not occur leave their threshold where
    it would be for one row of that grade.
    """
    n, top = len(grades), max(int(grades.max(initial=0)), 1)
    slots = sample.screened(grades > 0)
    column = np.full(SLOTS, -1)
    column[slots] = np.arange(len(slots))
    used = column[sample.slots] >= 0
    rows, columns, values = sample.rows[used], column[sample.slots[used]], sample.values[used]

    share = np.array([(np.count_nonzero(grades <= k) + 1) / (n + 2) for k in range(top)])
    cuts = np.log(share / (1 - share))
    # the first threshold and the logarithms of the steps to the next ones: ordered by construction
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])
    theta = np.concatenate([np.zeros(len(slots)), free])
    first, second = np.zeros(len(theta)), np.zeros(len(theta))
    lower, upper = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    for step in range(1, steps + 1):
        w, free = theta[: len(slots)], theta[len(slots) :]
        cuts = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(rows, w[columns] * values, n)
        above = np.where(grades < top, _logistic(cuts[upper] - score), 1.0)
        below = np.where(grades > 0, _logistic(cuts[lower] - score), 0.0)
        p = np.maximum(above - below, 1e-9)
        d_above = np.where(grades < top, above * (1 - above), 0.0) / p
        d_below = np.where(grades > 0, below * (1 - below), 0.0) / p
        g_score = (d_above - d_below) / n
        g_cuts = np.bincount(lower, d_below, top) / n - np.bincount(upper, d_above, top) / n
        g_free = np.concatenate([[g_cuts.sum()], np.exp(free[1:]) * np.cumsum(g_cuts[::-1])[::-1][1:]])
        g_w = np.bincount(columns, g_score[rows] * values, len(slots)) + penalty * w / n
        gradient = np.concatenate([g_w, g_free])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.05 * (1 - step / (steps + 1)) + 0.002
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    w, free = theta[: len(slots)], theta[len(slots) :]
    return Severity(slots, w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def grade(sample: Sample) -> np.ndarray:
    """Grades 0, 1 and 2 from labels that only say toxic or not.

    Screened features that are commoner in toxic rows mark toxicity; toxic rows
    with more marks than the median toxic row are of grade 2.
    """
    toxic = sample.toxic
    chosen = sample.screened(toxic)
    inside = np.bincount(sample.slots[toxic[sample.rows]], minlength=SLOTS)[chosen] / max(1, toxic.sum())
    outside = np.bincount(sample.slots[~toxic[sample.rows]], minlength=SLOTS)[chosen] / max(1, (~toxic).sum())
    marks_it = np.zeros(SLOTS, dtype=bool)
    marks_it[chosen[inside > outside]] = True
    used = marks_it[sample.slots]
    marks = np.bincount(sample.rows[used], sample.values[used], len(toxic))
    median = np.median(marks[toxic]) if toxic.any() else 0
    return toxic.astype(int) + (toxic & (marks > median))


def _chosen_slots(rows: DataFrame) -> np.ndarray:
    """The slots that ``screen`` chooses from stored rows of ``toxic`` and ``features``, counted by tasks."""
    is_toxic = F.when(F.col("toxic") > 0, 1).otherwise(0)
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum(is_toxic), F.lit(0))).first()
    if not n_toxic:
        return np.zeros(0, int)
    present = rows.select(is_toxic.alias("both"), F.explode(F.map_keys("features")).alias("slot"))
    counts = present.groupBy("slot").agg(F.count("*").alias("with_it"), F.sum("both").alias("both")).toArrow()
    slots = counts["slot"].to_numpy()
    with_it, both = np.zeros(SLOTS), np.zeros(SLOTS)
    with_it[slots], both[slots] = counts["with_it"].to_numpy(), counts["both"].to_numpy()
    return telling(with_it, both, n, n_toxic)


def _with_slots(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``rows`` with only the ``chosen`` slots among their ``features``."""
    others = [c for c in rows.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(SLOTS, bool)
        wanted[chosen] = True
        for batch in batches:
            features = batch.column("features")
            stays = wanted[features.keys.to_numpy()]
            ends = np.concatenate([[0], np.cumsum(stays)])[features.offsets.to_numpy()]
            kept = pa.array(np.flatnonzero(stays)[ends[0] : ends[-1]])
            offsets = pa.array(ends - ends[0], pa.int32())
            made = pa.MapArray.from_arrays(offsets, features.keys.take(kept), features.items.take(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), made], [*others, "features"])

    return rows.select(*others, "features").mapInArrow(run, rows.select(*others, "features").schema)


def sample_labelled(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_LABELLED
) -> Sample:
    """Labels and telling features of at most ``max_rows`` labelled rows, by a hash of the id.

    Rows with a null id, text or label are no labelled rows, and rows that agree
    in id, text and label are one. The ids are drawn before the texts are joined,
    so only drawn texts are read into features; as an id may have many texts, the
    bound is put on what the join gives once more. The driver gets ``max_rows`` rows.
    """
    drawn = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("_id").isNotNull() & F.col("toxic").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "toxic")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    joined = texts.join(F.broadcast(drawn), "_id").select(
        F.struct(F.xxhash64("_id").alias("a"), F.xxhash64("_text").alias("b")).alias("_order"), "_text", "toxic"
    )
    encoder = Features()
    found = replace_column(
        joined,
        "_text",
        "features",
        "map<int,int>",
        lambda texts: [sorted(encoder.of(t).items()) for t in texts],
        pa.map_(pa.int32(), pa.int32()),
    )
    # repeated rows meet as features, combined by the tasks that made them
    once = found.groupBy("_order.a", "_order.b", "toxic").agg(F.any_value("features").alias("features"))
    bounded = once.orderBy(F.xxhash64("a", "b"), "a", "b", "toxic").limit(max_rows)
    stored = keep(bounded.select("a", "b", "toxic", "features"), "labelled-features")
    chosen = _chosen_slots(stored)
    # in one order, so that sums agree to the last bit when the fit is run again
    rows = _with_slots(stored, chosen).toArrow().combine_chunks()
    rows = rows.sort_by([("a", "ascending"), ("b", "ascending"), ("toxic", "ascending")]).combine_chunks()
    features = rows["features"].combine_chunks() if len(rows) else pa.array([], pa.map_(pa.int32(), pa.int32()))
    sizes = np.diff(features.offsets.to_numpy()) if len(rows) else np.zeros(0, int)
    sample = Sample.of(sizes, features.keys.to_numpy(), features.items.to_numpy(), rows["toxic"].to_numpy() > 0)
    return replace(sample, chosen=chosen)


def train(docs: DataFrame, labels: DataFrame, **sample) -> Severity:
    """Fit on the labelled rows; without any, the model finds nothing toxic."""
    rows = sample_labelled(docs, labels, **sample)
    if not rows.toxic.any():
        return Severity(np.zeros(0, int), np.zeros(0), np.array([50.0, 51.0]))
    return fit(rows, grade(rows))


def score(docs: DataFrame, model: Severity, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless ``keep_text``, with ``severity``, ``toxic_probability``, ``grade`` and ``rejected``.

    ``severity`` is the expected grade. A null or empty text has no feature and
    gets what the thresholds alone say. Repeated rows score alike; columns of
    the same names are dropped.
    """
    named = ("severity", "toxic_probability", "grade")
    clash = [c for c in (*named, "rejected") if c in docs.columns and c != text_col]
    weights = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights, model.thresholds))
    state: dict = {}

    def run(texts: list[str | None]) -> list[dict]:
        if not state:
            state.update(dense=dict(zip(*(c.tolist() for c in weights.value[:2]))), encoder=Features())
        dense, encoder, cuts = state["dense"], state["encoder"], weights.value[2]
        out = []
        for text in texts:
            total = sum(dense[s] * math.log1p(n) for s, n in encoder.of(text).items() if s in dense)
            above = _logistic(total - cuts)
            grades = -np.diff(np.concatenate([[1.0], above, [0.0]]))
            out.append(
                {
                    "severity": float(above.sum()),
                    "toxic_probability": float(above[0]),
                    "grade": int(grades.argmax()),
                }
            )
        return out

    kind = "struct<severity:double,toxic_probability:double,grade:int>"
    arrow = pa.struct([("severity", pa.float64()), ("toxic_probability", pa.float64()), ("grade", pa.int32())])
    scored = replace_column(docs.drop(*clash), text_col, "_s", kind, run, arrow, keep_text)
    return (
        scored.select("*", "_s.*").drop("_s").withColumn("rejected", F.col("toxic_probability") >= MIN_PROBABILITY)
    )


def keep_clean(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject; all columns stay as they are, whatever their names."""
    named, back = set_aside(docs, ("severity", "toxic_probability", "grade", "rejected", "_s"))
    scored = score(named, model, text_col, keep_text=True)
    return given_back(scored.where(~F.col("rejected")), docs.columns, back)


def grade_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``."""
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col, **sample), text_col)
