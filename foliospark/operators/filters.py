"""The one filter that lists, counts and exports share."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.model import DIAGNOSIS, HANDWRITING, HANDWRITING_CATEGORIES, PAGE_CLASSES


def parse_enum(text: str | None, known: tuple[str, ...], strict: bool = False) -> list[str] | None:
    """Comma-separated values of a domain; unknown ones are dropped. None: no filter.

    If nothing is left of a given text, the filter is not applied, or with ``strict`` nothing passes (an empty list).
    """
    values = [v.strip() for v in (text or "").split(",") if v.strip()]
    kept = [v for v in values if v in known]
    return kept if kept or (strict and values) else None


def day_bound(text: str | None, end: bool) -> datetime | None:
    """A bare date is that day's first or last instant in UTC; an ISO instant stands as it is, without a zone in UTC; else no bound."""
    if not text:
        return None
    try:
        if len(text) == 10:
            at = datetime.fromisoformat(text)
            return at.replace(hour=23, minute=59, second=59, microsecond=999999, tzinfo=UTC) if end else at.replace(tzinfo=UTC)
        at = datetime.fromisoformat(text)
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    except ValueError:
        return day_bound(text[:10], end) if len(text) > 10 else None


@dataclass(frozen=True)
class PageFilters:
    """What a user asks for; fields that aren't set filter nothing."""

    batch_id: int | None = None
    case_id: int | None = None
    document_id: int | None = None
    patient_ref: str | None = None
    encounter_ref: str | None = None
    uploader: str | None = None
    uploaded_from: str | None = None
    uploaded_to: str | None = None
    page_class: str | None = None
    defect_code: list[str] = field(default_factory=list)
    handwriting: str | None = None
    diagnosis_status: str | None = None
    review_state: str | None = None
    q: str | None = None
    strict: bool = False
    limit: int | None = None
    offset: int = 0

    def predicates(self, columns: Iterable[str] = ("printed_label",)) -> list[Column]:
        """What each row must fulfil. ``columns`` of the view: a free text also looks at printed labels where it has them. ``limit`` and ``offset`` are the export's (``listing.windowed``)."""
        out = [F.col(c) == F.lit(v) for c in ("batch_id", "case_id", "document_id", "patient_ref", "encounter_ref", "uploader") if (v := getattr(self, c)) is not None and v != ""]
        for text, end in ((self.uploaded_from, False), (self.uploaded_to, True)):
            bound = day_bound(text, end)
            if bound is not None:
                at = F.lit(bound.astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
                out.append(F.col("uploaded_at") <= at if end else F.col("uploaded_at") >= at)
        classes = parse_enum(self.page_class, PAGE_CLASSES, self.strict)
        if classes is not None:
            out.append(F.col("effective_class").isin(*classes) if classes else F.lit(False))
        if self.review_state == "accepted":
            out.append(F.col("latest_action") == "accept")
        elif self.review_state == "rescan_requested":
            out.append(F.col("latest_action") == "request_rescan")
        elif self.review_state == "pending":
            out.append(F.col("flagged") & F.col("latest_action").isNull())
        if self.q:
            names = ["filename", "batch", "patient_ref", "encounter_ref", *(c for c in columns if c == "printed_label")]
            out.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{self.q.strip()}%"), F.lit(False)) for c in names]))
        return out


def _given(table: DataFrame | None, name: str) -> DataFrame:
    if table is None:
        raise ValueError(f"this filter needs the table of {name}")
    return table


def apply_filters(view: DataFrame, f: PageFilters, findings: DataFrame | None = None, regions: DataFrame | None = None, diagnoses: DataFrame | None = None) -> DataFrame:
    """Rows of the core view that pass. Child tables only decide (semi joins); they never multiply pages. A filter whose table is absent is an error."""
    for p in f.predicates(view.columns):
        view = view.filter(p)
    if f.defect_code:
        findings = _given(findings, "findings")
        view = view.join(findings.filter(F.col("code").isin(*f.defect_code)).select("page_id"), "page_id", "left_semi")
    status = parse_enum(f.handwriting, HANDWRITING, f.strict)
    category = parse_enum(f.handwriting, HANDWRITING_CATEGORIES)
    if status:
        view = view.filter(F.col("handwriting").isin(*status))
    if category:
        regions = _given(regions, "regions")
        view = view.join(regions.filter(F.col("category").isin(*category)).select("page_id"), "page_id", "left_semi")
    wanted = parse_enum(f.diagnosis_status, DIAGNOSIS, f.strict)
    if wanted is not None:
        diagnoses = _given(diagnoses, "diagnoses")
        has = diagnoses.groupBy("page_id").agg(F.bool_or(F.col("diagnosis_status").isin(*wanted)).alias("_has") if wanted else F.lit(False).alias("_has"))
        joined = view.join(has, "page_id", "left")
        view = joined.filter(F.col("_has") | (F.col("_has").isNull() & F.lit("pending" in wanted))).drop("_has")
    return view


def by_reference(text: str) -> Column:
    """A search text that begins with ip (any case) looks in encounter_ref, any other in patient_ref."""
    column = "encounter_ref" if text[:2].lower() == "ip" else "patient_ref"
    return F.col(column).ilike(f"%{text}%")


def local_window(day: str, zone: str, start: str = "00:00", end: str = "23:59") -> tuple[str, str]:
    """A day (and times) where the user lives as UTC instants; the end includes its whole minute."""
    at = lambda text: datetime.fromisoformat(f"{day}T{text}").replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
    return at(f"{start}:00").isoformat(), at(f"{end}:59.999000").isoformat()
