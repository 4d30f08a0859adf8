"""Exact removal of long repeated byte strings, by prefix-free parsing.

A rolling hash triggers phrase ends: the trigger of a window of ``length``
bytes is the smallest hash of its 64-byte strings, so each window has one, and
equal windows have theirs at the same place. The windows that share a trigger
form a phrase; together with the context that its last window needs, it is a
string of the dictionary. Copied text makes equal phrases, so the work that
follows grows with the dictionary and not with the copies:

- a trigger string that occurs once makes its windows unique;
- one whose phrases are all equal makes all of them repeated;
- only phrases that share a trigger string and differ are compared. Their
  distinct strings are suffix-sorted, by doubling prefixes, to the depth of a
  window; neighbours that agree to that depth are occurrences of one string.

The verdicts go back along the parse, and the windows found repeated are cut
from every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import buckets_for
from bibliospark.sources.durable import keep

LENGTH = 200
#: Bytes of a trigger string.
TRIGGER = 64
#: Texts are hashed together in buffers of about this size; longer texts in pieces of at most PIECE bytes.
BUFFER = 1 << 19
PIECE = 1 << 22
#: Dictionary bytes sorted together, and most distinct phrases of a trigger string that are.
DICTIONARY_BYTES = 1_000_000
MOST_PHRASES = 8_000

#: Texts that a task has uncompressed at once when it cuts them.
ROWS_AT_ONCE = 500

#: Odd multipliers, fixed so that hashes agree everywhere.
BASE = 0x9E3779B97F4A7C15
MIX = 0xFF51AFD7ED558CCD
PLACE_BITS = 24
PLACE = np.uint64((1 << PLACE_BITS) - 1)

PHRASES = "doc_id {}, text_hash binary, start int, n int, trigger long, phrase long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return _mixed((np.arange(1, 257, dtype=np.uint64)) * np.uint64(BASE))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :])


def parse(data: np.ndarray, lengths: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """The phrases of texts that stand one after the other in ``data``.

    Gives, per phrase, its text, its start in the text, its number of windows,
    the hash of its trigger string and the hash of the phrase with its context.
    """
    n = len(data)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    up, down = _powers(1 << max(BUFFER, n - 1).bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * up[:n], out=sums[1:])
    hashes = _mixed((sums[trigger:] - sums[:-trigger]) * down[: n - trigger + 1])
    places = np.arange(len(hashes), dtype=np.uint64)
    # of equal hashes the last counts, which holds wherever the same window stands
    least = _least((hashes & ~PLACE) | (PLACE - places), length - trigger + 1)
    at = (PLACE - (least & PLACE)).astype(np.int64)
    ends = np.cumsum(lengths)
    text_of = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    windows = np.flatnonzero(np.arange(length, len(at) + length) <= ends[text_of])
    at = at[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(windows) != 1)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(windows)))
    starts, triggers = windows[first], at[first]
    phrase = (sums[starts + counts - 1 + length] - sums[starts]) * down[starts]
    shape = (counts.astype(np.uint64) << np.uint64(32)) + (triggers - starts).astype(np.uint64)
    text = text_of[starts]
    return (
        text,
        starts - (ends - lengths)[text],
        counts,
        hashes[triggers].view(np.int64),
        _mixed(phrase ^ _mixed(shape * np.uint64(BASE))).view(np.int64),
    )


def parse_texts(texts: Iterable[bytes], length: int, trigger: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`parse` over buffers of texts; the first array counts through ``texts``."""
    pieces: list[tuple[int, int, bytes]] = []

    def flush() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
        found = parse(data, np.array([len(p[2]) for p in pieces]), length, trigger)
        number, offset = (np.array([p[k] for p in pieces]) for k in (0, 1))
        return number[found[0]], found[1] + offset[found[0]], *found[2:]

    held = 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for begin in range(0, len(text) - length + 1, PIECE):
            # a piece reaches into the next one so that no window is lost between them
            piece = text[begin : begin + PIECE + length - 1]
            pieces.append((i, begin, piece))
            held += len(piece)
            if held >= BUFFER:
                yield flush()
                pieces, held = [], 0
    if pieces:
        yield flush()


def phrases(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    """The phrases of ``docs`` (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text"))
            for text, start, n, at, phrase in parse_texts(texts, length, trigger):
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(row),
                        batch.column("text_hash").take(row),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(at),
                        pa.array(phrase),
                    ],
                    ["doc_id", "text_hash", "start", "n", "trigger", "phrase"],
                )

    return docs.mapInArrow(run, PHRASES.format(docs.schema["doc_id"].dataType.simpleString()))


def window_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each window at ``starts``, equal for equal windows, in suffix order.

    Ranks of all suffixes by their first 8, 16, 32, ... bytes; two overlapping
    ranks of the largest power of two within ``length`` name a window.
    """
    width, ranks, size = 1, data.astype(np.int64), 256
    if length >= 8 and len(data) >= 8:
        words = np.ndarray((len(data) - 7,), dtype=">u8", buffer=np.ascontiguousarray(data), strides=(1,))
        distinct, ranks = np.unique(words.astype(np.uint64), return_inverse=True)
        width, size = 8, len(distinct)
    while 2 * width <= length and len(ranks) > width:
        distinct, ranks = np.unique(ranks[:-width] * size + ranks[width:], return_inverse=True)
        width, size = 2 * width, len(distinct)
    return np.unique(ranks[starts] * size + ranks[starts + length - width], return_inverse=True)[1]


def runs_of(flags: np.ndarray) -> list[int]:
    """Start and length of each run of true flags, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [x for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) for x in (a, b - a)]


def _repeated_in_dictionary(dictionary: DataFrame, length: int, dictionary_bytes: int) -> DataFrame:
    """The repeated windows of each phrase (trigger, phrase, copies, n, bytes), as ``runs``."""
    whole = dictionary.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("trigger"), F.lit(buckets_for(whole, dictionary_bytes))).cast("int")

    def compare(table: pa.Table) -> pa.Table:
        strings = table.column("bytes").to_pylist()
        counts = table.column("n").to_numpy()
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        begins = np.cumsum([0, *map(len, strings[:-1])])
        owner = np.repeat(np.arange(len(strings)), counts)
        firsts = np.cumsum(counts) - counts
        starts = np.arange(counts.sum()) - np.repeat(firsts, counts) + begins[owner]
        named = window_classes(data, starts, length)
        copies = np.bincount(named, table.column("copies").to_numpy()[owner])
        flags = copies[named] > 1
        runs = [runs_of(flags[a : a + n]) for a, n in zip(firsts.tolist(), counts.tolist())]
        return table.select(["trigger", "phrase"]).append_column("runs", pa.array(runs, pa.list_(pa.int32())))

    return dictionary.groupBy(bucket.alias("bucket")).applyInArrow(
        compare, "trigger long, phrase long, runs array<int>"
    )


def _repeated_by_digest(dictionary: DataFrame, length: int) -> DataFrame:
    """As :func:`_repeated_in_dictionary`, for trigger strings of too many phrases: windows are
    counted by a 128-bit digest, combined before the shuffle, so no task holds a trigger's phrases."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (string, n) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("n").to_pylist())):
                digests = [hashlib.blake2b(string[j : j + length], digest_size=16).digest() for j in range(n)]
                row = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(row) for c in ("trigger", "phrase", "copies")]
                    + [pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())],
                    ["trigger", "phrase", "copies", "at", "digest"],
                )

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for hits in batch.column("hits").to_pylist():
                flags = np.zeros(max(hits) + 1, dtype=bool)
                flags[hits] = True
                runs.append(runs_of(flags))
            yield pa.RecordBatch.from_arrays(
                [batch.column("trigger"), batch.column("phrase"), pa.array(runs, pa.list_(pa.int32()))],
                ["trigger", "phrase", "runs"],
            )

    each = dictionary.select("trigger", "phrase", "copies", "n", "bytes").mapInArrow(
        windows, "trigger long, phrase long, copies long, at int, digest binary"
    )
    repeated = each.groupBy("digest").agg(F.sum("copies").alias("all")).where("all > 1").select("digest")
    hits = each.join(repeated, "digest").groupBy("trigger", "phrase").agg(F.collect_list("at").alias("hits"))
    return hits.mapInArrow(to_runs, "trigger long, phrase long, runs array<int>")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text_hash, text) with the text compressed, to be sent to a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(packed, pa.binary())],
                ["doc_id", "text_hash", "packed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash binary, packed binary")


def _unpack(packed: pa.Scalar) -> bytes:
    # a frame of an empty text says size 0, which the decompressor takes for unknown
    return zstandard.ZstdDecompressor().decompressobj().decompress(packed.as_buffer())


def _same_document(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _dictionary(docs: DataFrame, contested: DataFrame, length: int) -> DataFrame:
    """Each distinct contested phrase once, with its bytes, read from one text that has it."""
    once = contested.groupBy("trigger", "phrase").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("at")
    )
    wanted = once.select("at.doc_id", "at.text_hash", F.struct("trigger", "phrase", "copies", "at.start", "at.n").alias("p"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("p").alias("wanted"))
    texts = _packed(docs).alias("t")
    joined = texts.join(wanted, _same_document(texts, wanted)).select("packed", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, len(b), ROWS_AT_ONCE)):
            rows, strings = [], []
            for packed, asked in zip(batch.column("packed"), batch.column("wanted").to_pylist()):
                text = _unpack(packed)
                rows += asked
                strings += [text[w["start"] : w["start"] + w["n"] - 1 + length] for w in asked]
            columns = [pa.array([r[c] for r in rows], k) for c, k in (("trigger", pa.int64()), ("phrase", pa.int64()), ("copies", pa.int64()), ("n", pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(strings, pa.binary())], ["trigger", "phrase", "copies", "n", "bytes"]
            )

    return joined.mapInArrow(cut, "trigger long, phrase long, copies long, n int, bytes binary")


def repeated_windows(
    docs: DataFrame,
    length: int = LENGTH,
    trigger: int = TRIGGER,
    dictionary_bytes: int = DICTIONARY_BYTES,
    most_phrases: int = MOST_PHRASES,
) -> DataFrame:
    """Per phrase of ``docs`` (doc_id, text_hash, text) with repeated windows: ``start`` and ``runs`` of them."""
    found = phrases(docs, length, trigger)
    shared = keep(
        found.groupBy("trigger")
        .agg(F.count("*").alias("all"), (F.min("phrase") != F.max("phrase")).alias("contested"))
        .where("all > 1")
        .select("trigger", "contested"),
        "shared-triggers",
    )
    parse_of_shared = keep(found.join(shared, "trigger"), "shared-phrases")
    contested = parse_of_shared.where("contested")
    dictionary = keep(_dictionary(docs, contested, length), "phrase-dictionary")
    crowded = keep(
        dictionary.groupBy("trigger").agg(F.count("*").alias("k")).where(F.col("k") > most_phrases).select("trigger"),
        "crowded-triggers",
    )
    few = _repeated_in_dictionary(dictionary.join(crowded, "trigger", "left_anti"), length, dictionary_bytes)
    many = _repeated_by_digest(dictionary.join(crowded, "trigger", "left_semi"), length)
    verdicts = keep(few.unionByName(many).where(F.size("runs") > 0), "phrase-verdicts")
    whole = parse_of_shared.where("NOT contested").select(
        "doc_id", "text_hash", "start", F.array(F.lit(0), F.col("n")).alias("runs")
    )
    part = contested.join(verdicts, ["trigger", "phrase"]).select("doc_id", "text_hash", "start", "runs")
    return whole.unionByName(part)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    trigger: int = TRIGGER,
    dictionary_bytes: int = DICTIONARY_BYTES,
    most_phrases: int = MOST_PHRASES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (start, end) removed, and ``kept`` bytes.

    Texts are UTF-8 bytes and stay apart; a null text is empty. A byte is
    removed if a string of ``length`` bytes covers it that starts anywhere
    else too, be it in the same text. All is judged on the input. Repeated rows
    are copies of each other, and both lose what they share. Other columns are
    ignored. ``kept`` is binary, as a cut may part the bytes of a character.
    ``length`` must be at least ``trigger``.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_hash"),
        F.col(text_col).cast("binary").alias("text"),
    )
    hits = repeated_windows(rows, length, trigger, dictionary_bytes, most_phrases)
    # rows alike in id and text have the same hits, each of which is listed once
    listed = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "runs")).alias("hits"))
    # stored: were it still grouped by the join's key, adaptive execution could not split the rows of one text
    listed = keep(listed, "repeat-hits")
    texts = _packed(rows)
    joined = texts.join(listed, _same_document(texts, listed), "left").select(texts["doc_id"], "packed", "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, len(b), ROWS_AT_ONCE)):
            sizes, spans, kept = [], [], []
            for packed, hits in zip(batch.column("packed"), batch.column("hits").to_pylist()):
                text = _unpack(packed)
                edges = np.zeros(len(text) + 1, dtype=np.int32)
                for hit in hits or ():
                    for at, n in zip(hit["runs"][::2], hit["runs"][1::2]):
                        begin = hit["start"] + at
                        edges[begin] += 1
                        edges[begin + n - 1 + length] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                runs = runs_of(gone)
                sizes.append(len(text))
                spans.append([{"start": a, "end": a + n} for a, n in zip(runs[::2], runs[1::2])])
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if runs else text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
