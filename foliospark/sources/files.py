"""Incoming files: scan, validation, content hash, container probe."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import extension

# Accepted types and limits.
TYPES = {"pdf": "application/pdf", "tif": "image/tiff", "tiff": "image/tiff", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
MAX_BYTES, MAX_PAGES = 200 * 1024 * 1024, 2000
LABEL = r"^\(?\s*(\d{1,3})\s*\)?$"


def validated(name: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Why a file is refused: unsupported_type, empty or too_large; null if it is accepted."""
    return F.when(~extension(name).isin(*TYPES), "unsupported_type").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > most, "too_large")


def mime(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("application/octet-stream"))


def printed_label(text: Column) -> Column:
    """``(n)`` of a page corner's text; null if it isn't a number."""
    n = F.regexp_extract(F.trim(text), LABEL, 1)
    return F.when(n != "", F.concat(F.lit("("), n, F.lit(")")))


def scan(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Files below ``path`` with reason (null: accepted), mime and SHA-256; contents of refused files aren't hashed.

    Spark's reader leaves out files of no bytes; where listings come from elsewhere, ``validated`` names them empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    reason = validated(name, F.col("length"), most)
    return files.select("path", name.alias("filename"), "length", "modificationTime", reason.alias("reason"), mime(name).alias("mime"), F.when(reason.isNull(), F.sha2("content", 256)).alias("sha256"), "content")


def _tiff_pages(b: bytes) -> int:
    order = "little" if b[:2] == b"II" else "big"
    at, pages, seen = int.from_bytes(b[4:8], order), 0, set()
    while at and at not in seen and at + 2 <= len(b):
        seen.add(at)
        pages += 1
        end = at + 2 + 12 * int.from_bytes(b[at:at + 2], order)
        at = int.from_bytes(b[end:end + 4], order)
    return pages


def probe(name: str, b: bytes) -> tuple[int, str | None]:
    """(pages, warning) of a container, from its own bytes."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "pdf":
        if not b.lstrip()[:5] == b"%PDF-":
            return 0, "corrupted"
        if b"/Encrypt" in b[-4096:] or b"/Encrypt" in b[:4096]:
            return 0, "password_protected"
        pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", b))
    elif kind in ("tif", "tiff"):
        if b[:4] not in (b"II*\0", b"MM\0*"):
            return 0, "corrupted"
        pages = _tiff_pages(b)
    else:
        magic = {"png": b"\x89PNG", "jpg": b"\xff\xd8", "jpeg": b"\xff\xd8"}.get(kind)
        if magic is None or not b.startswith(magic):
            return 0, "corrupted"
        pages = 1
    return (pages, None) if 0 < pages <= MAX_PAGES else (pages, "too_many_pages" if pages else "corrupted")


def probed(files: DataFrame) -> DataFrame:
    """Adds page count and warning of each accepted file; a broken file is a row with a warning, not an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [probe(n, bytes(c)) if c is not None else (0, "corrupted") for n, c in zip(b["filename"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "pages": [f[0] for f in found], "warning": [f[1] for f in found]})

    return files.filter("reason IS NULL").select("path", "filename", "content").mapInPandas(run, "path string, pages int, warning string")
