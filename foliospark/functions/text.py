"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def shortened(c: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in an ellipsis. Carriage returns become spaces."""
    x = F.replace(c, F.lit("\r"), F.lit(" "))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, limit - 1), r"\s+$", ""), F.lit("…")))


def safe_part(c: Column, fallback: str, limit: int = 80) -> Column:
    """A part of a path: other characters become underscores, none lead or trail."""
    x = F.btrim(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.left(F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback)), F.lit(limit))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^.]+)$", 1))


def directory(c: Column) -> Column:
    """Up to the last slash; empty without one."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def masked(c: Column) -> Column:
    """The first character and the length."""
    return F.concat(F.left(c, F.lit(1)), F.lit("***("), F.length(c), F.lit(")"))


def script(c: Column) -> Column:
    """latin, devanagari, mixed or unknown, by the letters that a text holds."""
    latin, devanagari = c.rlike("[A-Za-z]"), c.rlike("[\\u0900-\\u097F]")
    return F.when(latin & devanagari, "mixed").when(devanagari, "devanagari").when(latin, "latin").otherwise("unknown")


def joined_key(*parts: Column) -> Column:
    """SHA-256 of the parts' text, joined by ``|``; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def redacted(entries: Column, forbidden: tuple[str, ...], longest: int = 120) -> Column:
    """A map without secrets: values of forbidden keys and long texts are replaced."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).isin(*forbidden), "<redacted>").when(F.length(v) > longest, "<redacted:long-string>").otherwise(v))


def without_uuids(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<id>")
