"""Packing token pieces into sequences by fitted length patterns.

A pattern is a few lengths that together fill a sequence almost to the end.
Patterns of two to four documents are enumerated over the histogram of piece
lengths, how often to repeat each is fitted by non-negative least squares, the
repeats are rounded down to what the histogram holds, and what remains is
packed by best fit, again on the histogram. The histogram has at most one bin
per length, so planning is bounded by the sequence length and not by the
corpus; the pieces stay distributed and look their places up in the plan.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import number_within
from bibliospark.operators.ids import assign_ids
from bibliospark.sources.durable import keep

SEQUENCE = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

#: A pattern may leave at most this many tokens of a sequence empty.
PATTERN_WASTE = 8
#: Second and third lengths tried for each first length.
PARTNERS = 24
FIT_STEPS = 400
#: Equal parts of an ordered corpus that are packed one by one.
SEGMENTS = 8
#: Runs of letters whose ids a worker remembers, up to this length; at the bound it starts anew.
REMEMBERED_RUNS = 500_000
REMEMBERED_LENGTH = 64
#: Characters of text that are split before new runs are merged.
PART = 1_000_000

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printing)
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts, as little-endian bytes.

    The vocabulary first splits a text into lower-case runs of letters, digits
    and other signs, and a run's ids do not depend on its neighbours. Texts are
    split here in the same way, runs that recur are remembered, and the
    tokenizer merges each new run once, many at a time. Only characters whose
    lower case, kind and bytes are beyond doubt are split here; a word with any
    other goes through the whole tokenizer. The vocabulary's special tokens are
    cut out of a text before anything else, as the tokenizer does.
    """

    #: The vocabulary's own split, for the characters below.
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\ra-z0-9\xdf-\xf6\xf8-\xff]+")
    #: Anything but printing ASCII, plain white space, Latin-1 letters and a few signs.
    OTHER = re.compile(r"[^ \t\n\r\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff\xa1\xab\xbb\xbf]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        special = self.whole.get_added_tokens_decoder()
        self.special = {token.content: np.array([i], "<u4").tobytes() for i, token in special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special)) + ")")
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = dict(self.special)

    def _runs(self, text: str) -> list[str]:
        """The runs of a text; a word with an unusual character is one entry, marked by a space before it."""
        if any(t in text for t in self.special):
            pieces = self.cut.split(text)
            return [r for p in pieces for r in ([p] if p in self.special else self._runs(p))]
        if not self.OTHER.search(text):
            return self.RUNS.findall(text.lower())
        out = []
        for word in text.replace("\n", " ").split(" "):
            out += [" " + word] if self.OTHER.search(word) else self.RUNS.findall(word.lower())
        return out

    def _learn(self, new: list[str]) -> None:
        unusual = [r for r in new if r[0] == " "]
        for at in range(0, len(unusual), 1_000):
            some = unusual[at : at + 1_000]
            for run, found in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False)):
                self.known[run] = np.array(found.ids, "<u4").tobytes()
        plain = [r for r in new if r[0] != " "]
        for at in range(0, len(plain), 1_000):
            some = plain[at : at + 1_000]
            mapped = " ".join(some)
            if not mapped.isascii():
                mapped = " ".join(r.encode().decode("latin-1").translate(self.letters) for r in some)
            found = self.merges.encode(mapped, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(found.word_ids), np.arange(len(some)), side="right").tolist()
            for run, begin, end in zip(some, [0, *ends], ends):
                self.known[run] = ids[4 * begin : 4 * end]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        runs = [self._runs(t) if t else [] for t in texts]
        found = [list(map(self.known.get, r)) for r in runs]
        missing = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        new = {r[i] for r, at in zip(runs, missing) for i in at}
        if len(self.known) + len(new) > REMEMBERED_RUNS:
            self.known = dict(self.special)
        self._learn(sorted(new))
        for r, f, at in zip(runs, found, missing):
            for i in at:
                f[i] = self.known[r[i]]
        for run in new:
            if len(run) > REMEMBERED_LENGTH:
                del self.known[run]
        return [b"".join(f) for f in found]


@cache
def encoder_for(path: str) -> WordIds:
    """One encoder for all tasks of a worker process, so that runs are remembered from task to task."""
    return WordIds(path)


def _in_parts(encoder: WordIds, texts: list[str | None]) -> Iterator[bytes]:
    """The ids of many texts, about a million characters at a time."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held > PART:
            yield from encoder.of(part)
            part, held = [], 0
    yield from encoder.of(part)


def tokenize_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    order: dict[str, Column] | None = None,
) -> DataFrame:
    """Pieces of at most ``sequence`` tokens: id, piece, start, length, crc of its ids, and ``order`` of their documents.

    Every document ends in ``end_id``; a null or empty text is that id alone.
    """
    carried = {name: value.alias(name) for name, value in (order or {}).items()}
    id_type = docs.schema[id_col].dataType.simpleString()
    end, size = np.array([end_id], "<u4").tobytes(), 4 * sequence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(_in_parts(encoder, batch.column("text").to_pylist())):
                ids = found + end
                for n, at in enumerate(range(0, len(ids), size)):
                    own = ids[at : at + size]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(c, pa.int64()) for c in (start, length, crc)),
                    *(batch.column(c).take(pa.array(row, pa.int64())) for c in carried_names),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", *carried_names],
            )

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried.values())
    carried_names = list(carried)
    schema = [PIECES.format(id_type), *(f"{c} {named.schema[c].dataType.simpleString()}" for c in carried_names)]
    return named.mapInArrow(cut, ", ".join(schema))


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, sequence: int, waste: int, partners: int) -> np.ndarray:
    """Rows of four indices into ``lengths`` (-1: none) that fill a sequence to within ``waste``."""
    n = len(lengths)
    common = np.unique(np.concatenate([
        np.linspace(0, n - 1, min(n, partners)).astype(int),
        np.argsort(-counts, kind="stable")[:partners],
    ]))
    every = np.arange(n)
    none = np.full(n, -1)
    found = []

    def close(rest: np.ndarray, chosen: list[np.ndarray]) -> None:
        """Complete patterns with the longest length that still fits."""
        last = np.searchsorted(lengths, rest, side="right") - 1
        ok = (last >= 0) & (rest > 0)
        ok[ok] &= rest[ok] - lengths[last[ok]] <= waste
        rows = np.stack([*chosen, last] + [none] * (3 - len(chosen)), axis=1)[ok]
        found.append(np.sort(rows, axis=1)[:, ::-1])

    close(sequence - lengths, [every])
    for a in common:
        rest = sequence - lengths - lengths[a]
        close(rest, [every, np.full(n, a)])
        for b in common[common <= a][:: max(1, len(common) // 8)]:
            close(rest - lengths[b], [every, np.full(n, a), np.full(n, b)])
    rows = np.concatenate(found) if found else np.empty((0, 4), int)
    return np.unique(rows, axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeats x with least squares error of (patterns x - counts).

    Accelerated projected gradient; scaling by the counts lets rare lengths
    weigh as much as common ones.
    """
    if not len(patterns):
        return np.zeros(0)
    used = patterns >= 0
    where = np.where(used, patterns, 0)
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))

    def apply(x: np.ndarray) -> np.ndarray:
        return scale * np.bincount(where.ravel(), (x[:, None] * used).ravel(), len(counts))

    def back(r: np.ndarray) -> np.ndarray:
        return ((scale * r)[where] * used).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest singular value, for the step
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1 / max(np.linalg.norm(back(apply(v))) * 1.1, 1e-12)
    goal = scale * counts
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(apply(y) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(lengths: list[int], counts: list[int], sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: (lengths in a sequence, how many such sequences)."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(bin_: tuple[int, ...], room: int, n: int) -> None:
        if room not in by_room:
            by_room[room] = {}
            insort(rooms, room)
        by_room[room][bin_] = by_room[room].get(bin_, 0) + n

    for length, count in sorted(zip(lengths, counts), reverse=True):
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # as many to a sequence as fit, all alike
                fit = sequence // length
                full, rest = divmod(count, fit)
                if full:
                    put((length,) * fit, sequence - fit * length, full)
                if rest:
                    put((length,) * rest, sequence - rest * length, 1)
                break
            room = rooms[at]
            bin_, n = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = room // length
            moved = min(n, count // each)
            if moved:
                put(bin_ + (length,) * each, room - each * length, moved)
            else:
                moved, each = 1, count
                put(bin_ + (length,) * each, room - each * length, 1)
            count -= moved * each
            if n > moved:
                put(bin_, room, n - moved)
    return [(b, n) for bins in by_room.values() for b, n in bins.items()]


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their repeats that hold every piece of the histogram.

    The fitted repeats are tried whole and scaled back, down to none, as what
    they leave over may pack better; the plan with the fewest sequences wins.
    """
    full = [((sequence,), histogram[sequence])] if histogram.get(sequence) else []
    lengths = np.array(sorted(k for k in histogram if k < sequence), dtype=int)
    counts = np.array([histogram[k] for k in lengths.tolist()], dtype=float)
    if not len(lengths):
        return full
    patterns = enumerate_patterns(lengths, counts, sequence, PATTERN_WASTE, PARTNERS)
    repeats = fit_repeats(patterns, counts)
    order = np.argsort(-repeats, kind="stable")
    best = None
    for scale in (1.0, 0.97, 0.9, 0.75, 0.5, 0.0):
        left = counts.astype(int)
        out = []
        for i in order:
            wanted = int(repeats[i] * scale)
            if not wanted:
                break
            own, times = np.unique(patterns[i][patterns[i] >= 0], return_counts=True)
            n = min(wanted, int((left[own] // times).min()))
            if n:
                left[own] -= n * times
                out.append((tuple(int(lengths[k]) for k in patterns[i] if k >= 0), n))
        rest = left > 0
        out += best_fit(lengths[rest].tolist(), left[rest].tolist(), sequence)
        if best is None or sum(n for _, n in out) < sum(n for _, n in best):
            best = out
    return full + best


Slots = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def slots_of(histogram: dict[int, int], sequence: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """The plan as rows (length, number, sequence, offset), and its number of sequences.

    The pieces of that length from that number on, up to the next row's, sit at
    this offset of that sequence and the ones after it.
    """
    rows, used, first = [], dict.fromkeys(histogram, 0), 0
    for lengths, n in plan(histogram, sequence):
        offset = 0
        for length in lengths:
            rows.append((length, used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    return rows, first


def _by_kind(rows: Iterable[tuple[int, int, int, int]]) -> Slots:
    """Rows like those of ``slots_of`` by their first value, sorted by number."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for kind, *slot in rows:
        slots.setdefault(kind, []).append(tuple(slot))
    return {k: tuple(np.array(c) for c in zip(*sorted(v))) for k, v in slots.items()}


def _put(numbered: DataFrame, kind: str, table: Slots, columns: list[str]) -> DataFrame:
    """``columns`` with ``sequence_id`` and ``offset`` of pieces that have a ``_number`` among those of their ``kind``."""
    shared = numbered.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(kind).to_numpy()
            numbers = batch.column("_number").to_numpy()
            ids, offsets = np.zeros(len(kinds), "int64"), np.zeros(len(kinds), "int64")
            for k in np.unique(kinds):
                starts, firsts, places = shared.value[int(k)]
                own = np.flatnonzero(kinds == k)
                at = np.searchsorted(starts, numbers[own], side="right") - 1
                ids[own] = firsts[at] + numbers[own] - starts[at]
                offsets[own] = places[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(ids), pa.array(offsets)],
                [*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in columns)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces`` (``length`` at most ``sequence``).

    ``pieces`` has a column ``_row`` with a number of its own for each row, which
    spreads repeated rows like any others and is dropped. Pieces of one length are numbered without gaps, by a hash of their key in
    tasks of bounded size, and the number of a piece finds its pattern, repeat
    and place. The plan, at most some tens of thousands of rows whatever the
    corpus, is sent to every task.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = _by_kind(slots_of(histogram, sequence)[0])
    numbered = number_within(
        pieces, "length", ["doc_id", "piece", "ids_crc32", "_row"], "_number", sum(histogram.values())
    ).drop("_row")
    return _put(numbered, "length", table, [c for c in numbered.columns if c != "_number"])


def pack_in_order(pieces: DataFrame, order: list[str], sequence: int = SEQUENCE, segments: int = SEGMENTS) -> DataFrame:
    """Like ``pack``, with sequences in the order of the columns ``order``, which are dropped.

    The pieces are numbered in that order and cut into ``segments`` equal parts.
    Each part has a histogram, a plan and sequences of its own, and those of
    later parts have larger numbers; inside a part sequences go by pattern. A
    part is planned by a task, which reads one row per length.
    """
    columns = [c for c in pieces.columns if c not in (*order, "_row")]
    placed = keep(assign_ids(pieces, [*order, "piece", "_row"], -1).select("id", *columns), "pieces-placed")
    total = placed.count()
    width = sequence + 1
    part = F.floor(F.col("id") * F.lit(segments) / F.lit(max(total, 1))).cast("long")
    parted = placed.withColumn("_kind", part * width + F.col("length"))
    histogram = parted.groupBy("_kind").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("_kind") / width))

    def plan_part(group: pd.DataFrame) -> pd.DataFrame:
        rows, sequences = slots_of(dict(zip((group["_kind"] % width).tolist(), group["n"].tolist())), sequence)
        made = pd.DataFrame(rows, columns=["length", "number", "first", "offset"])
        return made.assign(part=int(group["part"].iloc[0]), sequences=sequences)

    schema = "length long, number long, first long, offset long, part long, sequences long"
    # by a number of ranges, so that these few rows are not put together and parts are planned side by side
    slots = histogram.repartitionByRange(segments, "part").groupBy("part").applyInPandas(plan_part, schema).toPandas()
    before, first = {}, 0
    for at, sequences in sorted(slots.groupby("part")["sequences"].first().items()):
        before[at], first = first, first + sequences
    kinds, firsts = slots["part"] * width + slots["length"], slots["first"] + slots["part"].map(before)
    table = _by_kind(zip(*(c.astype(int).tolist() for c in (kinds, slots["number"], firsts, slots["offset"]))))
    numbered = number_within(parted, "_kind", ["id"], "_number", total)
    return _put(numbered, "_kind", table, columns)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    order: list[Column] | None = None,
) -> DataFrame:
    """One row per piece of ``docs`` with its place in a sequence.

    Only documents of more than ``sequence`` tokens are cut. A null or empty
    text makes one piece of one token; repeated rows make pieces of their own;
    a null id is kept. Other columns are ignored. No rows give no pieces. With
    ``order``, sequences follow the order of the documents, see ``pack_in_order``.
    """
    keys = [f"_order_{i}" for i in range(len(order or []))]
    pieces = tokenize_pieces(docs, tokenizer_path, id_col, text_col, sequence, order=dict(zip(keys, order or [])))
    stored = keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack_in_order(stored, keys, sequence) if order else pack(stored, sequence)


def stored_order(docs: DataFrame) -> list[Column] | None:
    """The order of rows that were sorted and written, from the files they are read from; None if they are not."""
    try:
        file = docs.metadataColumn("_metadata")
        name = file["file_name"]
        # numbers of files get longer in the end, so shorter names come first
        order = [F.char_length(name), name, file["row_index"]]
        docs.select(*order)
    except AnalysisException:
        return None
    return order
