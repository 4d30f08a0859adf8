"""Near duplicates by SimHash, found by comparing tiles of fingerprints exactly.

Distinct fingerprints are sorted by the population counts of their eight bytes
and cut into tiles. If two fingerprints differ in at most ``radius`` bits, the
counts of their bytes differ by at most ``radius`` in sum, so pairs of tiles,
and within them pairs of short runs, whose counts lie further apart are
skipped. What is left is compared whole, with numpy's exclusive-or and bit
counts. A pair of tiles gives out a spanning forest of its links and not the
links themselves, which keeps all components and grows with the tiles alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import fresh, replace_column
from bibliospark.operators.components import connected_components
from bibliospark.sources.durable import keep

SEED = 42
RADIUS = 3
SHINGLE = 3
#: Fingerprints in a tile, and in a run within it.
TILE = 16_384
RUN = 256
#: Tiles are laid out by the counts of this many bytes: at most 9 ** CELL_BYTES cells, planned on the driver.
CELL_BYTES = 5
#: Row b holds the eight bits of byte b, lowest first.
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text; no words give zero."""
    # bytes.lower and bytes.split know ASCII letters and white space only, as wanted
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], dtype=np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def add_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fingerprint`` (long, its 64 bits) instead of the text."""
    other = [c for c in docs.columns if c == "fingerprint" and c != text_col]
    return replace_column(
        docs.drop(*other), text_col, "fingerprint", "bigint", lambda ts: [fingerprint(t, shingle) for t in ts], pa.int64()
    )


def byte_counts(prints: np.ndarray) -> np.ndarray:
    """The population count of each byte, highest byte first."""
    return np.bitwise_count(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8).reshape(-1, 8))


def _gaps(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """For each a and b the least distance in sum between their boxes of counts."""
    low_a, high_a, low_b, high_b = (x.astype(np.int16) for x in (low_a, high_a, low_b, high_b))
    out = np.zeros((len(low_a), len(low_b)), dtype=np.int16)
    for k in range(low_a.shape[1]):
        apart = np.maximum(low_a[:, None, k] - high_b[None, :, k], low_b[None, :, k] - high_a[:, None, k])
        out += np.maximum(apart, 0)
    return out


def links(one: np.ndarray, other: np.ndarray | None, radius: int) -> np.ndarray:
    """Pairs of a spanning forest of all links between two sorted tiles, or within ``one``."""
    within = other is None
    prints = one if within else np.concatenate([one, other])
    parent = np.arange(len(prints))
    starts_a = np.arange(0, len(one), RUN)
    starts_b = starts_a if within else len(one) + np.arange(0, len(other), RUN)
    counts = byte_counts(prints)

    def boxes(starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        own = counts[starts[0] : end]
        return np.minimum.reduceat(own, starts - starts[0]), np.maximum.reduceat(own, starts - starts[0])

    def roots(at: np.ndarray) -> np.ndarray:
        up = parent[at]
        while True:
            higher = parent[up]
            if np.array_equal(higher, up):
                parent[at] = up
                return up
            up = higher

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    found = []
    near = _gaps(*boxes(starts_a, len(one)), *boxes(starts_b, len(prints))) <= radius
    if within:
        near = np.triu(near)
    for i, j in zip(*np.nonzero(near)):
        a = slice(starts_a[i], min(starts_a[i] + RUN, len(one)))
        b = slice(starts_b[j], min(starts_b[j] + RUN, len(prints)))
        close = np.bitwise_count(prints[a, None] ^ prints[None, b]) <= radius
        if not close.any():
            continue
        root_a = roots(np.arange(a.start, a.stop))
        root_b = roots(np.arange(b.start, b.stop))
        x, y = np.nonzero(close & (root_a[:, None] != root_b[None, :]))
        if not len(x):
            continue
        # one link for each two sets that meet here
        _, first = np.unique(root_a[x] * len(prints) + root_b[y], return_index=True)
        for p, q in zip((x[first] + a.start).tolist(), (y[first] + b.start).tolist()):
            top_p, top_q = root(p), root(q)
            if top_p != top_q:
                parent[max(top_p, top_q)] = min(top_p, top_q)
                found.append((p, q))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return prints[pairs].view(np.int64)


class Layout:
    """Which tile a fingerprint belongs to, and which tiles may hold links.

    Built from the number of fingerprints per cell. Neighbouring cells share a
    tile group; a cell of more than a tile is split by hash into ``subs`` tiles.
    """

    def __init__(self, cells: np.ndarray, counts: np.ndarray, tile: int, radius: int):
        order = np.argsort(cells)
        self.cells, counts = cells[order], counts[order]
        group, room, groups = -1, 0, np.zeros(len(cells), dtype=np.int64)
        subs: list[int] = []
        for i, n in enumerate(counts.tolist()):
            if n > room or n > tile:
                group, room = group + 1, tile
                subs.append(max(1, -(-n // tile)))
            room = 0 if n > tile else room - n
            groups[i] = group
        self.groups, self.subs = groups, np.array(subs, dtype=np.int64)
        digits = np.stack([self.cells // 9**k % 9 for k in range(CELL_BYTES - 1, -1, -1)], axis=1)
        firsts = np.flatnonzero(np.diff(groups, prepend=-1))
        self.low = np.minimum.reduceat(digits, firsts) if len(cells) else digits
        self.high = np.maximum.reduceat(digits, firsts) if len(cells) else digits
        self.first_tile = np.concatenate([[0], np.cumsum(self.subs)])
        self.radius = radius

    def tiles_of(self, cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        group = self.groups[np.searchsorted(self.cells, cells)]
        return self.first_tile[group] + hashes.astype(np.uint64) % self.subs[group].astype(np.uint64)

    def partners(self, tile: int) -> list[int]:
        """The tiles to compare ``tile`` with, itself included."""
        g = int(np.searchsorted(self.first_tile, tile, side="right")) - 1
        near = _gaps(self.low[g : g + 1], self.high[g : g + 1], self.low, self.high)[0] <= self.radius
        return [
            t for h in np.flatnonzero(near).tolist() for t in range(self.first_tile[h], self.first_tile[h + 1])
        ]


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (``a``, ``b``) among the distinct, stored longs ``fingerprint`` that join the same components as all links do."""
    cell = F.lit(0)
    for k in range(CELL_BYTES):
        cell = cell * 9 + F.bit_count(F.shiftrightunsigned("fingerprint", 56 - 8 * k).bitwiseAND(F.lit(255)))
    placed = prints.select("fingerprint", cell.cast("int").alias("cell"))
    # at most 9 ** CELL_BYTES rows, whatever the corpus
    histogram = placed.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    layout = Layout(histogram["cell"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), tile, radius)
    shared = prints.sparkSession.sparkContext.broadcast(layout)

    def to_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy()
            hashes = batch.column("hash").to_numpy()
            tiles = shared.value.tiles_of(batch.column("cell").to_numpy(), hashes.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(tiles.astype(np.int64))], ["fingerprint", "tile"])

    def pack_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)
        own = own[np.lexsort((own, *byte_counts(own).T[::-1]))]
        me = int(pdf["tile"].iloc[0])
        others = shared.value.partners(me)
        return pd.DataFrame(
            {
                "one": [min(me, t) for t in others],
                "other": [max(me, t) for t in others],
                "tile": me,
                "prints": [own.tobytes()] * len(others),
            }
        )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = {t: np.frombuffer(p, dtype=np.uint64) for t, p in zip(pdf["tile"], pdf["prints"])}
        one, other = int(pdf["one"].iloc[0]), int(pdf["other"].iloc[0])
        if one == other:
            found = links(tiles[one], None, radius)
        elif len(tiles) == 2:
            found = links(tiles[one], tiles[other], radius)
        else:  # a tile that the hash left empty
            found = np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    hashed = placed.withColumn("hash", F.xxhash64("fingerprint"))
    tiled = hashed.mapInArrow(to_tiles, "fingerprint long, tile long")
    sent = tiled.groupBy("tile").applyInPandas(pack_tile, "one long, other long, tile long, prints binary")
    return sent.groupBy("one", "other").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Every row of ``docs`` without its text, with ``fingerprint``, ``component`` (longs) and ``component_id``.

    Fingerprints that differ in at most ``radius`` bits are linked, and
    ``component_id`` is the smallest id that links reach, a row's own included;
    ``component`` is a fingerprint that names the component.
    Null and empty texts have fingerprint zero and are linked like others;
    repeated rows share a component. A null id is no smallest id unless its
    component has no other. Columns of ``docs`` with those names are replaced.
    """
    clash = [c for c in ("component", "component_id") if c in docs.columns]
    rows = keep(add_fingerprints(docs.drop(*clash), text_col, shingle), "fingerprints")
    prints = keep(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    found = keep(link_fingerprints(prints.select("fingerprint"), radius), "fingerprint-links")
    parts = keep(connected_components(found), "fingerprint-components")
    rooted = prints.join(parts, prints["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", F.col("root").alias("component"), "component_id")
    return rows.join(named, "fingerprint").select(*rows.columns, "component", "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **near) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest hash of the text.

    A null id comes after all others. Of rows with the same id and text one stays.
    """
    mine, nth = fresh("text_hash", docs), fresh("nth", docs)
    key = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    found = near_duplicates(key, "id", "text", **near)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash")
    first = found.groupBy("component").agg(F.min(order).alias("first"))
    first = first.select(F.col("first.id").alias(fresh("id", docs)), F.col("first.hash").alias(fresh("hash", docs)))
    of_first = [first[c] for c in first.columns]
    hashed = docs.withColumn(mine, F.xxhash64(text_col))
    kept = hashed.join(first, F.col(id_col).eqNullSafe(of_first[0]) & (F.col(mine) == of_first[1]), "left_semi")
    same = Window.partitionBy(id_col, mine).orderBy(F.lit(0))
    return kept.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)
