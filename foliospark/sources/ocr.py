"""Recognised text as providers send it, into one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON of a page with text anchors.
ANCHORED = "struct<text:string,tokens:array<struct<segments:array<struct<start:int,end:int>>,confidence:double>>>"


def anchored_text(text: Column, segments: Column) -> Column:
    """Text that segments ``[start, end)`` point to, joined."""
    return F.array_join(F.transform(segments, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "")


def in_spans(offset: Column, end: Column, spans: Column) -> Column:
    """Does ``[offset, end)`` overlap any span ``[start, end)``? Null if there are no spans at all."""
    return F.when(F.size(spans) > 0, F.exists(spans, lambda s: (offset < s["end"]) & (end > s["start"])))


def snapped(angle: Column) -> Column:
    """The nearest of 0, 90, 180 and 270 degrees on the circle; the smaller of two."""
    turn = lambda t: F.least(F.pmod(angle - t, F.lit(360.0)), F.pmod(t - angle, F.lit(360.0)))
    return F.array_min(F.transform(F.array(*map(F.lit, (0, 90, 180, 270))), lambda t: F.struct(turn(t).alias("d"), t.alias("t"))))["t"]


ANSWER = "struct<medicines:array<struct<name:string,dose:string,confidence:string>>,uncertainties:array<string>,needs_confirmation:boolean,summary:string>"


def reasoning(answer: Column) -> Column:
    """A model's JSON answer; null if it isn't a valid JSON object, or medicines or uncertainties aren't lists (of objects; of anything), which callers report as an error."""
    parsed = F.try_parse_json(answer)
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")), F.lit("VOID"))
    lists = kind("medicines").rlike(r"^(VOID|ARRAY<(VOID|OBJECT<.*>)>)$") & kind("uncertainties").rlike(r"^(VOID|ARRAY<.*>)$")
    whole = parsed.isNotNull() & answer.rlike(r"^\s*\{") & lists
    return F.when(whole, F.from_json(answer, ANSWER))


def needs_confirmation(r: Column) -> Column:
    """The model says so or says nothing of it, a medicine isn't of high confidence, or something is uncertain. Null without an answer."""
    unsure = F.coalesce(F.exists(r["medicines"], lambda m: ~m["confidence"].eqNullSafe("high")), F.lit(False)) | (F.coalesce(F.size(r["uncertainties"]), F.lit(0)) > 0)
    return F.when(r.isNotNull(), F.coalesce(r["needs_confirmation"], F.lit(True)) | unsure)


def prescription_status(r: Column) -> Column:
    """not_a_prescription only if the summary says so and no medicine was read."""
    none = F.coalesce(F.size(r["medicines"]), F.lit(0)) <= 0
    return F.when(r.isNull(), "failed").when(none & F.lower(r["summary"]).contains("not a prescription"), "not_a_prescription").otherwise("extracted")
