"""WARC archives of pages, and a capture index in global order.

Spark's text sink writes the archives: a record is a row and the blank lines that end a record are the line separator, so archives are
committed like any table and lie wherever Spark can write. They are read back by content length. Each archive gives a run of captures that is sorted
by url key and time; runs are dealt by ranges of the key and each range's runs are merged by a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import attach_groups, scratch_path, small_batches, written

_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
#: Captures that one range of the merged index holds.
RANGE_ROWS = 20_000

CAPTURE = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string, url_key string, captured string, archive string, position long, length long")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1: each 15 hex digits are 12 base-32 digits, renamed."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, at + 1, n), 16, 32), n * 4 // 5, "0") for at, n in ((0, 15), (15, 15), (30, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int) -> tuple[DataFrame, int]:
    """A row for each page, ``value`` its WARC record without the two line ends behind it and ``bytes`` its payload's size; and the largest of these."""
    payload = F.coalesce("html", F.lit(""))
    rows = (pages.select("page_id", "url", payload.alias("payload"))
            .withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")}))
    large = F.when(F.col("bytes") >= least, F.col("digest"))
    groups = (rows.select("page_id", large.alias("same")).filter("same IS NOT NULL")
              .groupBy("same").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1"))
    total, largest = rows.agg(F.count("*"), F.coalesce(F.max("bytes"), F.lit(0))).first()
    copies, rows = written(groups, "copies"), rows.withColumn("same", large)
    if copies.isEmpty():  # then no payload has to move
        rows = rows.withColumn("original", F.lit(None).cast("long"))
    else:
        rows = attach_groups(rows, copies, "same", "copies", total)
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(_END))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        field("WARC-Date", when),
        F.coalesce(field("WARC-Target-URI", clean), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(_PROFILE)), field("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("original"), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block)
    return rows.select(record.alias("value"), "bytes"), largest


def write_archives(pages: DataFrame, path: str, least: int = 0, per_archive: int = 1000, archive_bytes: int = 1 << 28, compression: str = "gzip") -> None:
    """Write a record of each page below ``path``, at most ``per_archive`` and about ``archive_bytes`` in a file (that bounds what reading one takes).

    Payloads of more than ``archive_bytes / per_archive`` bytes go to files of their own kind, fewer in each; a larger one than ``archive_bytes`` has its file to itself.

    Of payloads that are equal and have ``least`` bytes or more, the one with the largest page_id is a response and the others revisit it. Captures are
    dated a second apart from 2020 on, by page_id. With gzip a file is one member.
    """
    rows, largest = records(pages, least)

    def write(part: DataFrame, number: int) -> None:
        part.select("value").write.mode("append").option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", number).text(path)

    each = archive_bytes // per_archive
    if largest <= each:
        write(rows, per_archive)
        return
    write(rows.filter(F.col("bytes") <= each), per_archive)
    while each < largest:  # kinds of 16 times the size, up to the largest
        write(rows.filter((F.col("bytes") > each) & (F.col("bytes") <= 16 * each)), max(1, archive_bytes // (16 * each)))
        each *= 16


_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://")


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the rest, lower-cased: related captures sort together."""
    rest = _SCHEME.sub("", (url or "").lower()).partition("#")[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def parse_archive(data: bytes, archive: str) -> list[tuple]:
    """Captures of one archive, in the order of ``CAPTURE``. A payload that doesn't match its digest is an error."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{archive} has no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(head["Content-Length"])
        block = data[start:start + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind, number = head["WARC-Type"], int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (len(payload) != number or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{archive}: the payload at {at} doesn't match its digest")
        key = head["WARC-Record-ID"][1:-1].removeprefix(_ID)
        refers = head.get("WARC-Refers-To")
        url = head.get("WARC-Target-URI")
        out.append((None if key == "none" else int(key), number, digest, kind, int(refers[1:-1].removeprefix(_ID)) if refers else None,
                    url, url_key(url), head["WARC-Date"], archive, at, start + size - at))
        at = start + size + 4
    return out


def sort_key(capture: tuple) -> tuple:
    return capture[6], capture[7], capture[0] is None, capture[0] or 0, capture[8], capture[9]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``; those of an archive come together, sorted by url key and time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = sorted(parse_archive(bytes(text.as_buffer()), name), key=sort_key)
                if rows:
                    yield _batch(rows)

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("archive"))
    return files.mapInArrow(parse, CAPTURE)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


@dataclass
class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so that each row costs one match per level."""

    runs: list[Iterator[tuple]]

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        heads = [next(r, None) for r in self.runs]
        keys = [h and sort_key(h) for h in heads]

        def beats(a: int, b: int) -> bool:
            if a < 0 or b < 0:
                return b < 0 and a >= 0
            if keys[a] is None or keys[b] is None:
                return keys[b] is None and (keys[a] is not None or a < b)
            return (keys[a], a) < (keys[b], b)

        losers = [-1] * k
        winner = -1
        for leaf in range(k):  # play each leaf up; the first to come to a node waits there
            at, up = leaf, (leaf + k) // 2
            while up:
                if losers[up] < 0:
                    losers[up], at = at, -1
                    break
                if beats(losers[up], at):
                    losers[up], at = at, losers[up]
                up //= 2
            if at >= 0:
                winner = at
        while winner >= 0 and heads[winner] is not None:
            yield heads[winner]
            heads[winner] = next(self.runs[winner], None)
            keys[winner] = heads[winner] and sort_key(heads[winner])
            at, up = winner, (winner + k) // 2
            while up:
                if beats(losers[up], at):
                    losers[up], at = at, losers[up]
                up //= 2
            winner = at


def merged_index(captures: DataFrame) -> DataFrame:
    """All captures in the global order of url key, time and page_id: ranges of the key, each merged from the archives' sorted runs.

    A range is cut by the whole sorting key, so a url with very many captures spreads over ranges.
    """
    ranges = max(1, -(-captures.count() // RANGE_ROWS))
    order = ["url_key", "captured", "page_id", "archive", "position"]
    dealt = captures.repartitionByRange(ranges, *order).sortWithinPartitions("archive", *order[:2], F.col("page_id").asc_nulls_last(), "position")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[8], []).append(row)
        out: list[tuple] = []
        for row in LoserTree([iter(r) for r in runs.values()]):
            out.append(row)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(merge, CAPTURE)


def archive_and_index(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back and return their index (columns of ``CAPTURE``) in global order.

    Null html is an empty payload. Rows that repeat a page_id are records of their own; a null page_id never is the original of a group unless the group has no other.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least)
    small_batches(spark, 1)  # an archive at a time
    captures = written(read_archives(spark, path), "runs")
    small_batches(spark)
    return merged_index(captures)
