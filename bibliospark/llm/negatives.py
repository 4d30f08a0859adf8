"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. By the triangle
inequality on the sphere, the angles of two vectors to one direction bound the
angle between them from both sides, and all directions together give an interval for
its cosine. Times both norms, with room for rounding, this is an interval for
their integer inner product.

Vectors are dealt to shards and sorted there by label and angle, so that runs
of rows lie close together and share one interval. For an anchor's
positives only runs that can reach its best so far are scored; a positive's
score then opens a window for negatives, and only runs whose interval overlaps
a window are scored. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import buckets_for
from bibliospark.sources.durable import keep

SCALE = 256
#: Rows of a shard, anchors of a block, and anchors scored at once.
SHARD_ROWS, ANCHOR_ROWS, TOGETHER = 16_384, 1_024, 64
#: Rows that share one interval.
RUN = 64
#: Reference directions, picked far apart from a sample of this many vectors; they decide speed, never results.
DIRECTIONS, SAMPLE = 16, 2_048
#: Room for rounding, as a part of the product of two norms; angles are exact to about 1e-8.
ROUNDING = 1e-6


def _usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"))
    whole = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    return keep(whole.withColumn("row", F.monotonically_increasing_id()), "labelled-vectors")


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit directions of the sample, each next one the farthest from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.empty((0, sample.shape[1]))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < n and nearest.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _angles(matrix: np.ndarray, directions: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    units = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    return np.arccos(np.clip(units @ directions.T, -1, 1))


def _integers(matrix: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of a kind that holds them."""
    if not np.isfinite(matrix).all():
        raise OverflowError("a component times the scale is no double")
    if np.abs(matrix).max(initial=0) < 1 << 62:
        return matrix.astype(np.int64)
    return np.array([[int(x) for x in row] for row in matrix], dtype=object).reshape(matrix.shape)


class Anchors:
    """Some vectors with their labels and angles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, angles: np.ndarray):
        self.ids, self.labels, self.matrix, self.angles = ids, labels, matrix, angles
        self.norms = np.linalg.norm(matrix, axis=1)
        self.peak = float(np.abs(matrix).max(initial=0))

    def some(self, at: slice) -> Anchors:
        return Anchors(self.ids[at], self.labels[at], self.matrix[at], self.angles[at])


class Shard(Anchors):
    """Vectors sorted by label and angle, in runs that share intervals."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, angles: np.ndarray):
        super().__init__(ids, labels, matrix, angles)
        starts = np.arange(0, len(ids), RUN)
        self.starts, self.ends = starts, np.minimum(starts + RUN, len(ids))
        low, high = np.minimum.reduceat, np.maximum.reduceat
        self.angle_low, self.angle_high = low(angles, starts), high(angles, starts)
        self.norm_low, self.norm_high = low(self.norms, starts), high(self.norms, starts)
        self.label_low, self.label_high = low(labels, starts), high(labels, starts)
        #: Runs that were scored, and all that were in question.
        self.scored = self.asked = 0

    def intervals(self, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and run the least and the largest score that the run can hold."""
        a = anchors.angles[:, None, :]
        near = np.maximum(np.maximum(a - self.angle_high, self.angle_low - a), 0)
        reach_low, reach_high = a + self.angle_low, a + self.angle_high
        far = np.where(reach_high <= np.pi, reach_high, np.where(reach_low >= np.pi, 2 * np.pi - reach_low, np.pi))
        most = np.cos(near).min(axis=2, initial=1.0)
        least = np.cos(far).max(axis=2, initial=-1.0)
        own = anchors.norms[:, None]
        upper = most * own * np.where(most >= 0, self.norm_high, self.norm_low)
        lower = least * own * np.where(least >= 0, self.norm_low, self.norm_high)
        room = ROUNDING * own * self.norm_high + 1
        return lower - room, upper + room

    def rows_of(self, runs: np.ndarray) -> np.ndarray:
        """The rows of the runs that are marked."""
        marked = np.repeat(runs, self.ends - self.starts)
        self.scored += int(runs.sum())
        return np.flatnonzero(marked)

    def scores(self, anchors: Anchors, rows: np.ndarray) -> np.ndarray:
        """Integer inner products of all ``anchors`` with ``rows``."""
        width = max(1, self.matrix.shape[1])
        largest = self.peak * anchors.peak * width
        matrix = self.matrix if len(rows) == len(self.ids) else self.matrix[rows]
        if largest < 1 << 53:  # every partial sum is a whole double
            return (anchors.matrix @ matrix.T).astype(np.int64)
        a, b = _integers(anchors.matrix), _integers(matrix)
        if largest >= 1 << 62:
            a, b = a.astype(object), b.astype(object)
        return a @ b.T

    def positives(self, anchors: Anchors, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each anchor ids and scores of its ``k`` best other rows of the same label, best first."""
        _, upper = self.intervals(anchors)
        own = anchors.labels[:, None]
        alike = (self.label_low <= own) & (own <= self.label_high)
        self.asked += int(alike.any(axis=0).sum())
        upper = np.where(alike, upper, -np.inf)
        # the runs that may hold the best come first and give a threshold
        ahead = np.zeros(upper.shape[1], dtype=bool)
        best = np.argsort(-upper, axis=1, kind="stable")[:, : 1 + -(-k // RUN)]
        ahead[best[np.take_along_axis(alike, best, axis=1)]] = True
        first = self.rows_of(ahead)
        ok, found = self._of_label(anchors, first)
        least = np.array([np.sort(s[m])[-k] if m.sum() >= k else -np.inf for s, m in zip(found, ok)])
        late = (alike & (upper >= least.astype(float)[:, None])).any(axis=0) & ~ahead
        if late.any():
            rest = self.rows_of(late)
            more_ok, more = self._of_label(anchors, rest)
            ok, found = np.concatenate([ok, more_ok], axis=1), np.concatenate([found, more], axis=1)
            first = np.concatenate([first, rest])
        return [self._best(self.ids[first[m]], s[m], k) for s, m in zip(found, ok)]

    def _of_label(self, anchors: Anchors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = (self.labels[rows] == anchors.labels[:, None]) & (self.ids[rows] != anchors.ids[:, None])
        return other, self.scores(anchors, rows)

    def _best(self, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > k:
            some = np.flatnonzero(scores >= np.sort(scores)[-k])
            ids, scores = ids[some], scores[some]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def negatives(
        self, anchors: Anchors, windows: list[list[tuple[int, int]]], k: int
    ) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and each of its windows (least, largest score) the ``k`` best rows of other labels in it."""
        lower, upper = self.intervals(anchors)
        own = anchors.labels[:, None]
        overlap = np.zeros(upper.shape, dtype=bool)
        for i, some in enumerate(windows):
            for least, most in some:
                overlap[i] |= (upper[i] >= least) & (lower[i] <= most) if least <= most else False
        unlike = (self.label_low != own) | (self.label_high != own)
        self.asked += int(unlike.any(axis=0).sum())
        rows = self.rows_of((overlap & unlike).any(axis=0))
        found = self.scores(anchors, rows)
        out = []
        for i, some in enumerate(windows):
            bottom, top = min((w[0] for w in some), default=0), max((w[1] for w in some), default=-1)
            fit = np.flatnonzero((self.labels[rows] != anchors.labels[i]) & (found[i] >= bottom) & (found[i] <= top))
            ids, scores = self.ids[rows[fit]], found[i][fit]
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            falling = -scores
            cut = []
            for least, most in some:
                begin = int(np.searchsorted(falling, -most))
                end = min(begin + k, int(np.searchsorted(falling, -least, side="right")))
                cut.append((ids[begin:end], scores[begin:end]))
            out.append(cut)
        return out


def _packed(rows: DataFrame, number: Column, name: str, width: int, directions: np.ndarray, scale: int) -> DataFrame:
    """One stored row per shard or block: ids, labels, whole components and angles, by label, direction and angle."""

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks()
        matrix = np.zeros((len(table), width))
        # a shorter vector ends in zeros
        matrix[np.arange(width) < vectors.value_lengths().to_numpy()[:, None]] = vectors.flatten().to_numpy()
        matrix = np.floor(matrix * scale)
        angles = _angles(matrix, directions)
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        nearest = angles.argmin(axis=1) if len(directions) else np.zeros(len(ids), int)
        to_nearest = angles.min(axis=1, initial=np.pi)
        order = np.lexsort((ids, to_nearest, nearest, labels))
        return pa.table(
            {
                name: pa.array([table.column("number")[0].as_py()], pa.int32()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()),
                "labels": pa.array([labels[order].tobytes()], pa.binary()),
                "matrix": pa.array([matrix[order].tobytes()], pa.binary()),
                "angles": pa.array([angles[order].tobytes()], pa.binary()),
            }
        )

    numbered = rows.withColumn("number", number)
    schema = f"{name} int, ids binary, labels binary, matrix binary, angles binary"
    return keep(numbered.groupBy("number").applyInArrow(pack, schema), f"vector-{name}s")


def _meet(shards: DataFrame, n_shards: int, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """A row for every shard beside every block of anchors, and one for every block beside every shard."""
    if "windows" in blocks.columns:
        shards = shards.withColumn("windows", F.lit(None).cast(blocks.schema["windows"].dataType))
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("asks", F.lit(False))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("asks", F.lit(True))
    return left.unionByName(right)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    ``is_anchor`` tells from the column ``id`` which rows are anchors, and
    ``label`` (the column ``label`` by default) gives whole numbers. An
    anchor's positives are its best ``positives`` other rows of its label; for
    each, the best ``negatives`` rows of other labels come out whose score is
    from ``least`` to ``most`` per cent of the positive's, so a positive with a negative
    score has none. Scores are inner products of floor(``scale`` * x); ties go to the smaller id.

    Rows without an id, label or vector, and vectors with a null or non-finite
    component, take no part; a shorter vector counts as ending in zeros, an
    empty one as zeros. Repeated rows are candidates each, a repeated anchor is
    answered each time, and rows with the anchor's id are not its positives.
    Extra columns are ignored; no rows give no rows. Components may be of any
    size; a score in the result that is no long is an error.
    """
    rows = _usable(vectors, id_col, F.col("label") if label is None else label, vector_col)
    size = rows.agg(
        F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("vector")).alias("width")
    ).first()
    width = size.width or 0
    n_shards, n_blocks = buckets_for(size.n, SHARD_ROWS), buckets_for(size.anchors, ANCHOR_ROWS)
    drawn = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("vector").collect()
    sample = np.zeros((len(drawn), width))
    for at, r in enumerate(drawn):
        sample[at, : len(r.vector)] = r.vector
    directions = far_apart(np.floor(sample * scale), DIRECTIONS)

    def deal(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    shards = _packed(rows, deal(n_shards), "shard", width, directions, scale)
    blocks = _packed(rows.where(is_anchor), deal(n_blocks), "block", width, directions, scale)

    def parts(table: pa.Table) -> tuple[Shard, Anchors, list] | None:
        """The shard, the anchors and their windows of one group, if it has both."""
        found: dict[bool, tuple] = {}
        windows: list = []
        for line in table.to_pylist():
            ids = np.frombuffer(line["ids"], np.int64)
            angles = np.frombuffer(line["angles"]).reshape(len(ids), len(directions))
            found[line["asks"]] = (
                ids, np.frombuffer(line["labels"], np.int64), np.frombuffer(line["matrix"]).reshape(len(ids), width), angles
            )
            windows = (line.get("windows") or []) if line["asks"] else windows
        return (Shard(*found[False]), Anchors(*found[True]), windows) if len(found) == 2 else None

    def find_positives(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("block", "place", "anchor_id", "id", "score")}
        if both := parts(table):
            shard, anchors, _ = both
            block = table.column("block")[0].as_py()
            for at in range(0, len(anchors.ids), TOGETHER):
                some = anchors.some(slice(at, at + TOGETHER))
                for i, (ids, scores) in enumerate(shard.positives(some, positives)):
                    out["block"] += [block] * len(ids)
                    out["place"] += [at + i] * len(ids)
                    out["anchor_id"] += [int(some.ids[i])] * len(ids)
                    out["id"] += ids.tolist()
                    out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = _meet(shards, n_shards, blocks, n_blocks).groupBy("shard", "block").applyInArrow(
        find_positives, "block long, place long, anchor_id long, id long, score long"
    )
    by_score = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    ranked = keep(found, "shard-positives").withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives)
    windows = ranked.groupBy(F.col("block").cast("int").alias("block")).agg(
        F.collect_list(F.struct("place", "nth", "id", "score")).alias("windows")
    )

    def find_negatives(table: pa.Table) -> pa.Table:
        names = ("block", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        out: dict[str, list] = {c: [] for c in names}
        if both := parts(table):
            shard, anchors, asked = both
            block = table.column("block")[0].as_py()
            own: dict[int, list] = {}
            for w in asked:
                own.setdefault(w["place"], []).append(w)
            for at in range(0, len(anchors.ids), TOGETHER):
                some = anchors.some(slice(at, at + TOGETHER))
                asks = [own.get(at + i, []) for i in range(len(some.ids))]
                bounds = [[(-(-least * w["score"] // 100), most * w["score"] // 100) for w in ws] for ws in asks]
                for i, cuts in enumerate(shard.negatives(some, bounds, negatives)):
                    for w, (ids, scores) in zip(asks[i], cuts):
                        fixed = (block, at + i, w["nth"], int(some.ids[i]), w["id"], w["score"])
                        for c, v in zip(names, fixed):
                            out[c] += [v] * len(ids)
                        out["negative_id"] += ids.tolist()
                        out["negative_score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    kinds = "block long, place long, nth long, anchor_id long, positive_id long, positive_score long"
    hard = _meet(shards, n_shards, blocks.join(windows, "block"), n_blocks).groupBy("shard", "block").applyInArrow(
        find_negatives, f"{kinds}, negative_id long, negative_score long"
    )
    order = Window.partitionBy("block", "place", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return (
        keep(hard, "shard-negatives")
        .withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
