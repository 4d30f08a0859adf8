"""Secrets in texts, told apart by how many repositories and owners share them.

Every candidate is hashed. Per hash, the distinct repositories and owners that
hold it are counted over the distinct texts of the corpus, so that a document
copied to another source adds none: a value that many owners and repositories
carry is a copied example, one that stays with few owners and looks random is
taken for live. Assignments, access keys and long hex runs are always reported; the
corpus decides which of them are live, and which further random-looking tokens
are reported besides.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import given_back, replace_column, set_aside
from bibliospark.sources.durable import keep

#: The kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A further token: a long run of base64 characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIN_ASSIGNED = 6

#: A value in more owners and more repositories than this is a copied example.
MAX_OWNERS = 2
#: Bits per character, and kinds of characters, from which a value looks live.
MIN_BITS = 3.0
MIN_CLASSES = 2

ARROW_CANDIDATES = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("hash", pa.binary()),
            ("live_looking", pa.bool_()),
        ]
    )
)
CANDIDATES = "array<struct<kind:int,start:int,end:int,hash:binary,live_looking:boolean>>"


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Mixed kinds of characters without the regularity of words and placeholders."""
    kinds = (str.islower, str.isupper, str.isdigit)
    mixed = sum(any(map(k, value)) for k in kinds) >= MIN_CLASSES
    return mixed and bits_per_character(value) >= MIN_BITS


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of assignments, access keys and hex runs, sorted."""
    found = [
        (m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED
    ]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that overlap no base span."""
    found = []
    for m in TOKEN.finditer(text):
        value = m[0]
        if any(s < m.end() and m.start() < e for s, _, e, _ in taken):
            continue
        letters_and_digits = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if letters_and_digits and looks_live(value):
            found.append((m.start(), 3, m.end(), value))
    return found


def find_candidates(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``candidates`` to ``docs``, without the text unless ``keep_text``."""

    def scan(texts: list[str | None]) -> list[list[dict]]:
        out = []
        for text in texts:
            base = base_spans(text) if text else []
            spans = sorted(base + token_spans(text, base)) if text else []
            out.append(
                [
                    {
                        "kind": kind,
                        "start": start,
                        "end": end,
                        "hash": hashlib.sha256(value.encode()).digest(),
                        "live_looking": looks_live(value),
                    }
                    for start, kind, end, value in spans
                ]
            )
        return out

    return replace_column(docs, text_col, "candidates", CANDIDATES, scan, ARROW_CANDIDATES, keep_text)


def ownership(found: DataFrame, owner_col: str, repository_cols: list[str]) -> DataFrame:
    """Per candidate hash the number of distinct ``owners`` and ``repositories``.

    Copies of a text, rows with the same ``_text_hash``, count as one owner and
    repository, the least of theirs, however many hold it. Rows are reduced to
    distinct ones in the tasks that read them, so a value that fills a third of
    the corpus costs a few rows.
    """
    holder = F.struct(F.col(owner_col).alias("owner"), F.struct(*repository_cols).alias("repository"))
    # stored, so that the join with the candidates of a heavy text can be split
    texts = keep(found.groupBy("_text_hash").agg(F.min(holder).alias("_least")), "secret-texts")
    seen = found.select(F.explode("candidates.hash").alias("hash"), "_text_hash").distinct()
    counted = seen.join(texts, "_text_hash").select("hash", "_least.owner", "_least.repository")
    repositories = counted.groupBy("hash", "repository").agg(F.lit(1).alias("_one")).groupBy("hash").agg(
        F.count("*").alias("repositories")
    )
    owners = counted.groupBy("hash", "owner").agg(F.lit(1).alias("_one")).groupBy("hash").agg(F.count("*").alias("owners"))
    return owners.join(repositories, "hash").select("hash", "owners", "repositories")


def _listed(spans: Column) -> Column:
    """kind:start:end, joined by commas; ``spans`` is sorted."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source", "lang"),
    max_owners: int = MAX_OWNERS,
    keep_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its columns, without the text unless ``keep_text``, and ``spans``.

    ``spans`` is an array of (kind, start, end, owners, repositories, verdict),
    sorted by start, then kind; positions count code points. ``verdict`` is
    ``copied`` (more than ``max_owners`` owners and as many repositories, see
    ``ownership``), else ``live`` (looks random) or ``plain``. Further tokens
    are spans only if live. A null or empty text has no spans. A null owner
    counts as one owner. Repeated rows are kept; they add no owner. Columns of
    ``docs`` named ``candidates``, ``spans`` or ``_text_hash`` are dropped.

    Documents without candidates take no part in the shuffles: their rows are
    passed on as they are. The scan is done once and stored, but with
    ``keep_text``, when rows are wide, only rows with candidates are stored and
    the others are scanned again.
    """
    clash = [c for c in ("candidates", "spans", "_text_hash") if c in docs.columns]
    hashed = docs.drop(*clash).withColumn("_text_hash", F.xxhash64(text_col))
    found = find_candidates(hashed, text_col, keep_text)
    if not keep_text:
        found = keep(found, "secret-candidates")
    columns = [c for c in found.columns if c not in ("candidates", "_text_hash")]
    # stored, the key of a row stays the same however often the rows are read
    keyed = found.where(F.size("candidates") > 0).withColumn("_row", F.monotonically_increasing_id())
    keyed = keep(keyed, "secret-rows")
    # stored, so that the join with the candidates can be split where one value is in very many rows
    counts = keep(ownership(keyed, owner_col, list(repository_cols)), "secret-owners")
    copied = (F.col("owners") > max_owners) & (F.col("repositories") > max_owners)
    verdict = F.when(copied, "copied").when(F.col("live_looking"), "live").otherwise("plain")
    judged = (
        keyed.select("_row", F.inline("candidates"))
        .join(counts, "hash")
        .withColumn("verdict", verdict)
        .where((F.col("kind") < KINDS.index("token")) | (F.col("verdict") == "live"))
    )
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "verdict")))
    per_row = judged.groupBy("_row").agg(spans.alias("spans"))
    with_some = keyed.join(per_row, "_row", "left").select(*columns, "spans")
    without = found.where(F.size("candidates") == 0).select(*columns, F.lit(None).cast(with_some.schema["spans"].dataType).alias("spans"))
    both = with_some.unionByName(without)
    return both.withColumn("spans", F.coalesce("spans", F.array().cast(both.schema["spans"].dataType)))


def _equals(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [
        F.size(F.filter(F.col("spans")["kind"], _equals(i))).cast("long").alias(f"n_{KINDS[i]}")
        for i in range(3)
    ]
    return scanned.select(
        id_col,
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "copied")).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **scan) -> DataFrame:
    """``docs`` with every span that is not a copied example replaced by ``mask``.

    Overlapping spans become one mask. Columns and rows stay as they are, also
    columns that have the names of the scan's own.
    """
    named, back = set_aside(docs, ("candidates", "spans", "_text_hash", "_row"))
    scanned = scan_secrets(named, text_col, keep_text=True, **scan)
    secret = F.filter("spans", lambda s: s["verdict"] != "copied")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, span: Column) -> Column:
        more = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        inside = span["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], more, F.lit(mask))).alias("out"),
        )

    masked = F.aggregate(
        secret, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    )
    hidden = scanned.withColumn(text_col, F.when(F.size(secret) > 0, masked).otherwise(text))
    return given_back(hidden, docs.columns, back)
