"""WARC archives of pages, and an index of captures in global order.

Writing: pages with equal payloads are stored once. The page with the largest
id is a response record, the others are revisit records that refer to it. Each
task writes the records of its pages as gzip-compressed WARC files; offsets and
lengths in the index count in the uncompressed archive.

Reading: each archive is parsed by one task, checked against its digests and
turned into index entries sorted by URL key, time and page id, a sorted run.
Spark's range partitioner cuts the runs at common keys, and every range merges
its pieces of all runs with a loser tree. Ranges in a row give the captures of
the whole collection in order, each URL's history together.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import buckets_for
from bibliospark.sources.durable import keep, new_path

#: Fixed by the formats: the base32 alphabet, record ends, and the revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Captures are dated one second apart from here, by page id, as pages have no time of their own.
FIRST_CAPTURE = 1_600_000_000
CAPTURE_SPAN = 1_000_000_000
#: Payload bytes in one archive file, which one task reads whole; a larger payload has a file to itself.
FILE_BYTES = 64 << 20
#: Payloads are archived by size, so that a number of records bounds the bytes: limits of each class but the last.
SIZE_CLASSES = (16 << 10, 256 << 10, 4 << 20)
#: Index entries that one task merges, about.
ENTRIES_PER_RANGE = 50_000

ENTRY = pa.struct(
    [
        ("urlkey", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
ENTRY_SQL = (
    "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, offset long, length long"
)


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string column."""
    digits = F.sha1(payload)
    out = []
    for i in range(8):  # five hex digits are four base32 digits
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*out)


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def _page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record per page, as text, without the record end.

    A null html or url is empty. Of pages with equal payloads of at least
    ``min_bytes`` bytes the largest ``page_id`` is the response; rows that
    share that id are responses all of them, and a null id is smaller than any.
    """
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), clean_url.alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html").cast("long")})
    responses = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("at"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))
    )
    # stored: were it still grouped by the join's key, adaptive execution could not split a payload that many pages share
    joined = rows.join(keep(responses, "responses"), ["digest", "bytes"], "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    second = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CAPTURE_SPAN))
    utc = F.to_utc_timestamp(F.timestamp_seconds(second), F.current_timezone())
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(RECORD_END),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, "html"))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _page_urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", PROFILE),
                _line("WARC-Refers-To", _page_urn(F.col("first_id"))),
                _line("WARC-Refers-To-Target-URI", F.col("first_url")),
            ),
        ).otherwise(""),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", size.cast("string")),
    )
    return joined.select(F.concat(head, F.lit("\r\n"), body).alias("value"))


def size_classes(pages: DataFrame) -> list[tuple[Column, int]]:
    """(which payloads, records per file) of each class of sizes that occurs in ``pages``."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    limits = [-1, *SIZE_CLASSES]
    within = [(size > low) & (size <= high) for low, high in zip(limits, SIZE_CLASSES)] + [size > SIZE_CLASSES[-1]]
    per_file = [max(1, FILE_BYTES // high) for high in SIZE_CLASSES] + [1]
    counts = pages.agg(*(F.count_if(c) for c in within)).first()
    return [(c, n) for c, n, found in zip(within, per_file, counts) if found]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the pages as WARC files in folders below ``path``; the text writer adds the record ends.

    Equal payloads are of one class of sizes, so classes are written one by one.
    """
    for number, (of_size, per_file) in enumerate(size_classes(pages)):
        out = records(pages.where(of_size), min_bytes).write.option("lineSep", RECORD_END)
        out.option("maxRecordsPerFile", per_file).option("compression", "gzip").text(f"{path}/sizes-{number}")


def url_key(url: str) -> str:
    """The host's labels from the top down, then path and query, without scheme, www, port 80 or 443 and fragment."""
    rest = re.sub(r"#.*$", "", re.sub(r"^[a-zA-Z]+://", "", url), flags=re.S)
    host = re.match(r"[^/?]*", rest)[0]
    path = rest[len(host) :]
    host = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", host.lower()))
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(named fields, offset, length, block) of the records of an archive."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        lines = content[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = head_end + 4
        end = start + int(fields["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, at, end + 4 - at, content[start:end]
        at = end + 4


def _page_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def order_of(entry: dict) -> tuple:
    """The order of the index: URL key, time, page id (null first), then what remains."""
    page = entry["page_id"]
    return (entry["urlkey"], entry["captured"], page is not None, page or 0, entry["archive"], entry["offset"])


def entries_of(archive: str, content: bytes) -> list[dict]:
    """The sorted index entries of an archive; a payload that does not match its digest is an error."""
    found = []
    for fields, offset, length, block in parse(content):
        http_end = block.index(b"\r\n\r\n") + 4
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        declared = int(re.search(rb"Content-Length: (\d+)", block[:http_end])[1])
        if fields["WARC-Type"] == "response":
            payload = block[http_end:]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != declared:
                raise ValueError(f"{archive}: payload at byte {offset} does not match its digest")
        refers = fields.get("WARC-Refers-To")
        found.append(
            {
                "urlkey": url_key(fields["WARC-Target-URI"]),
                "captured": fields["WARC-Date"],
                "page_id": _page_of(fields["WARC-Record-ID"]),
                "payload_bytes": declared,
                "payload_digest": digest,
                "record_type": fields["WARC-Type"],
                "refers_to": _page_of(refers) if refers else None,
                "archive": archive,
                "offset": offset,
                "length": length,
            }
        )
    return sorted(found, key=order_of)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; each archive's are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = pa.array(entries_of(name, gzip.decompress(content.as_buffer())), ENTRY)
                yield pa.RecordBatch.from_struct_array(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, ENTRY_SQL)


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists; each step replays one path from a leaf to the root."""
    k = len(runs)
    at = [0] * k
    head = [r[0] if r else None for r in runs]  # None: the run is used up

    def loses(a: int, b: int) -> bool:
        """Whether run ``a`` has no claim before run ``b``; -1 stands for a run before all others."""
        if b == -1 or a == -1:
            return b == -1
        if head[a] is None or head[b] is None:
            return head[a] is None
        return head[b] < head[a]

    losers = [-1] * max(k, 1)

    def replay(run: int) -> None:
        node = (run + k) // 2
        while node > 0:
            if loses(run, losers[node]):
                run, losers[node] = losers[node], run
            node //= 2
        losers[0] = run

    for run in range(k - 1, -1, -1):
        replay(run)
    while k and head[losers[0]] is not None:
        run = losers[0]
        yield head[run]
        at[run] += 1
        head[run] = runs[run][at[run]] if at[run] < len(runs[run]) else None
        replay(run)


def sorted_runs(rows: Iterable[dict]) -> list[list[tuple]]:
    """``rows`` as (order, entry), in lists that are sorted: an archive's entries in turn, as they came."""
    runs: dict[str, list[tuple]] = {}
    done = []
    for entry in rows:
        order = order_of(entry)
        own = runs.setdefault(entry["archive"], [])
        if own and order < own[-1][0]:  # a run that was read in two pieces, the later one first
            done.append(own)
            own = runs[entry["archive"]] = []
        own.append((order, entry))
    return done + list(runs.values())


def merge_runs(runs: DataFrame) -> DataFrame:
    """The entries of stored ``runs`` with ``position``, their place in the global order from 0.

    Captures of one URL, and even of one URL and second, fall into several
    ranges where there are many, as page id, archive and offset are part of
    the key. The driver keeps what Spark's range partitioner samples, a fixed
    number of keys per range; the places where ranges begin are a table.
    """
    ranges = buckets_for(runs.count(), ENTRIES_PER_RANGE)
    placed_schema = f"{ENTRY_SQL}, range int, place long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        # orders differ, as archive and offset do, so entries themselves are never compared
        pieces = sorted_runs(row for batch in batches for row in batch.to_pylist())
        merged = [entry for _, entry in loser_tree_merge(pieces)]
        for begin in range(0, len(merged), 10_000):
            part = pa.RecordBatch.from_struct_array(pa.array(merged[begin : begin + 10_000], ENTRY))
            columns = [*part.columns, pa.array([number] * len(part), pa.int32()), pa.array(range(begin, begin + len(part)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "range", "place"])

    cut = runs.repartitionByRange(ranges, "urlkey", "captured", "page_id", "archive", "offset")
    merged = keep(cut.mapInArrow(merge, placed_schema), "capture-index")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("range").agg(F.count("*").alias("_n"))
    starts = starts.select("range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = merged.join(starts, "range")
    return placed.withColumn("position", F.col("_start") + F.col("place")).drop("range", "place", "_start")


def archive_and_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, read them back and index them.

    One row per page, also for repeated rows; an empty table gives no rows.
    Extra columns are ignored. A task holds the payloads of one archive at a
    time, ``FILE_BYTES`` or a single page.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    # an archive for no pages, so that there is a folder to read
    spark.range(0).select(F.lit("").alias("value")).write.text(f"{path}/none")
    write_archives(pages, path, min_bytes)
    return merge_runs(keep(read_runs(spark, path), "capture-runs"))
