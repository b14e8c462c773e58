"""Screens of cases, documents, pages, extractions and jobs: their filters, projections and totals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.filters import day_bound
from foliospark.operators.listing import rescan_list
from foliospark.plans.model import JOB_STATES

# Rows of a screen by default and at most; states of documents that came to nothing; keys kept beside a region's box.
LIMITS = {"pages": (200, 1000), "documents": (100, 1000), "cases": (50, 500), "jobs": (100, 500), "recent": (20, 1000)}
FAILED_UPLOADS = ("failed", "rejected", "corrupted", "password_protected")
SAFETY_KEYS = ("note", "cleaning_applied", "ambiguous_abbreviations")


def screen_limit(kind: str, asked: int | None = None) -> int:
    """Rows of a screen: its default, or what was asked for within 1 and its maximum."""
    usual, most = LIMITS[kind]
    return usual if asked is None else min(max(asked, 1), most)


def _equal(column: str, value: object) -> list[Column]:
    return [] if value is None or value == "" else [F.col(column) == F.lit(value)]


def _like(column: str, text: str | None) -> list[Column]:
    return [F.col(column).ilike(f"%{text}%")] if text else []


def _window(column: str, start: str | None, end: str | None) -> list[Column]:
    at = lambda bound: F.lit(bound.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    low, high = day_bound(start, False), day_bound(end, True)
    return ([F.col(column) >= at(low - low.utcoffset())] if low else []) + ([F.col(column) <= at(high - high.utcoffset())] if high else [])


def _where(rows: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    for c in conditions:
        rows = rows.filter(c)
    return rows


def case_list(cases: DataFrame, batch_id: int | None = None, patient_ref: str | None = None, encounter_ref: str | None = None,
              created_from: str | None = None, created_to: str | None = None) -> DataFrame:
    """Cases of a batch whose references hold a text (any case), entered inside a window."""
    return _where(cases, [*_equal("batch_id", batch_id), *_like("patient_ref", patient_ref), *_like("encounter_ref", encounter_ref), *_window("created_at", created_from, created_to)])


def open_pages(view: DataFrame) -> DataFrame:
    """Flagged pages that no reviewer has closed."""
    return view.filter(F.col("flagged") & F.col("latest_action").isNull())


def document_list(documents: DataFrame, view: DataFrame, batch_id: int | None = None, case_id: int | None = None, status: str | None = None, q: str | None = None,
                  needs_review: bool = False, uploaded_from: str | None = None, uploaded_to: str | None = None) -> DataFrame:
    """Documents (with batch_id) of a batch, case, status, name and window; ``needs_review`` keeps those with an open page."""
    rows = _where(documents, [*_equal("batch_id", batch_id), *_equal("case_id", case_id), *_equal("status", status), *_like("filename", q), *_window("uploaded_at", uploaded_from, uploaded_to)])
    return rows.join(open_pages(view).select("document_id"), "document_id", "left_semi") if needs_review else rows


def diagnosis_queue(extractions: DataFrame, pages: DataFrame, reviews: DataFrame, status: str | None = None, hide_not_found: bool = False, reviewed: bool | None = None) -> DataFrame:
    """Extractions of the pages that passed a filter. ``reviewed`` asks for any review or for none; None asks for neither."""
    rows = _where(extractions, _equal("diagnosis_status", status)).join(pages.select("page_id"), "page_id", "left_semi")
    if hide_not_found:
        rows = rows.filter("diagnosis_status <> 'not_found'")
    return rows if reviewed is None else rows.join(reviews.select("extraction_id"), "extraction_id", "left_semi" if reviewed else "left_anti")


def job_list(jobs: DataFrame, state: str | None = None, kind: str | None = None, document_id: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest jobs first. An unknown state is an error."""
    if state and state not in JOB_STATES:
        raise ValueError(f"no such state: {state}")
    rows = _where(jobs, [*_equal("state", state), *_equal("kind", kind), *_equal("document_id", document_id)])
    return rows.orderBy(F.desc_nulls_last("queued_at"), F.desc("job_id")).offset(max(offset, 0)).limit(screen_limit("jobs", limit))


def totals(rows: DataFrame, passes: Column) -> DataFrame:
    """How many rows pass a filter and how many there are, in one scan."""
    return rows.agg(F.count_if(passes).alias("total"), F.count("*").alias("grand_total"))


def page_summary(view: DataFrame, findings: DataFrame | None, regions: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame | None) -> DataFrame:
    """The row of a page list, 26 fields. ``page_class`` is the engine's; codes and categories are sorted and distinct. What a view has no column of is null.

    ``handwriting_region_count`` is null for pages whose handwriting was never looked at. ``diagnoses`` and ``prescriptions`` have one row a page.
    Without ``findings`` the view's own array of that name counts, without ``prescriptions`` its ``prescription_status``: no join is needed then.
    """
    codes = findings.groupBy("page_id").agg(F.sort_array(F.collect_set("code")).alias("defect_codes")) if findings is not None else None
    hand = regions.groupBy("page_id").agg(F.sort_array(F.collect_set("category")).alias("handwriting_categories"), F.count("*").alias("_regions"))
    read = prescriptions.select("page_id", "prescription_status") if prescriptions is not None else None
    rows = view if findings is not None else view.withColumn("defect_codes", F.sort_array(F.array_compact(F.array_distinct("findings.code"))))
    for child in (codes, hand, diagnoses.select("page_id", "diagnosis_status"), read):
        rows = rows if child is None else rows.join(child, "page_id", "left")
    empty = F.array().cast("array<string>")
    known = lambda name, kind: F.col(name) if name in view.columns else F.lit(None).cast(kind).alias(name)
    return rows.select(
        known("version_id", "long"), known("printed_label", "string"), known("width", "long"), known("height", "long"), known("colour_mode", "string"), known("capture_profile", "string"), known("quality_score", "double"), "page_id", "document_id", "batch_id", "batch", "case_id", "patient_ref", "encounter_ref", "filename", "ordinal", F.col("versions").alias("version_no"),
        F.coalesce("overall", F.lit("unchecked")).alias("page_class"), F.coalesce("defect_codes", empty).alias("defect_codes"),
        F.col("handwriting").alias("handwriting_status"), F.coalesce("handwriting_categories", empty).alias("handwriting_categories"),
        F.when(F.col("handwriting_status").isNotNull(), F.coalesce("_regions", F.lit(0))).alias("handwriting_region_count"),
        F.coalesce("diagnosis_status", F.lit("pending")).alias("diagnosis_status"), "prescription_status", "review_state", "uploaded_at")


def document_detail(documents: DataFrame, view: DataFrame, logical: DataFrame | None = None) -> DataFrame:
    """A row per document with its pages in order (page_id, ordinal, versions, class). A document has few pages; one without any has an empty list.

    ``logical`` (page_id, document_id, ordinal, printed_label, version_count) names all pages, also those without an active version: these have no
    ``active_version_id`` and are unchecked. With it, each page also has ``printed_label`` and ``active_version_id``.
    """
    fields = ["ordinal", "page_id", F.coalesce("overall", F.lit("unchecked")).alias("page_class")]
    if logical is None:
        rows = view
        fields.insert(2, F.col("versions").alias("version_count"))
    else:
        rows = logical.join(view.select("page_id", "overall", F.col("version_id").alias("active_version_id")), "page_id", "left")
        fields = [*fields[:2], "version_count", fields[2], "printed_label", "active_version_id"]
    page = F.struct(*fields)
    pages = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    joined = documents.join(pages, "document_id", "left")
    return joined.withColumn("pages", F.coalesce("pages", F.filter(F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema["pages"].dataType.elementType])), lambda x: F.lit(False))))


def rescan_rows(passed: DataFrame, narrowed: bool) -> DataFrame:
    """The rescan list of rows that passed the filters. Where these name a page class or a review state (``narrowed``), all rows stay."""
    return passed if narrowed else rescan_list(passed)


def safety_context(document: Column) -> dict[str, Column]:
    """What a stored JSON object says apart from the region: region (a map; null if empty), note, cleaning_applied, ambiguous_abbreviations.

    Values of the region keep their JSON text; lists that are absent, or no lists, are empty; malformed JSON has no region.
    """
    entries = F.from_json(document, "map<string,string>")
    region = F.map_filter(entries, lambda k, v: ~k.isin(*SAFETY_KEYS))
    words = lambda key: F.coalesce(F.from_json(F.get_json_object(document, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
    return {"region": F.when(F.size(region) > 0, region), "note": F.nullif(F.get_json_object(document, "$.note"), F.lit("")),
            "cleaning_applied": words("cleaning_applied"), "ambiguous_abbreviations": words("ambiguous_abbreviations")}


def job_state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("jobs"))


def unfiltered_processing(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of what a dashboard shows whatever its filters are: jobs in four states and all files."""
    states = jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "failed", "cancelled")])
    return states.withColumn("files", documents.agg(F.count("*")).scalar())


def case_work(cases: DataFrame, documents: DataFrame, jobs: DataFrame, failed: tuple[str, ...] = FAILED_UPLOADS) -> DataFrame:
    """Failed documents and queued or running jobs of each case. Only jobs of a document count: jobs of a page's stages carry no document."""
    bad = documents.groupBy("case_id").agg(F.count_if(F.col("status").isin(*failed)).alias("failed"))
    live = jobs.filter(F.col("state").isin("queued", "running") & F.col("document_id").isNotNull()).groupBy("document_id").agg(F.count("*").alias("_jobs"))
    work = documents.select("document_id", "case_id").join(live, "document_id").groupBy("case_id").agg(F.sum("_jobs").alias("open_jobs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cases.select("case_id").join(bad, "case_id", "left").join(work, "case_id", "left").select("case_id", zero("failed"), zero("open_jobs"))


def list_footer(rows: DataFrame) -> DataFrame:
    """Of the rows of a case list: how many have scans, and how many are still at work."""
    return rows.agg(F.count_if(F.col("pages") > 0).alias("with_scans"), F.count_if(F.col("open_jobs") > 0).alias("working"))


def open_work(view: DataFrame) -> DataFrame:
    """Pages that await review by document, and the sum over all documents in ``all_documents``."""
    by_document = open_pages(view).groupBy("document_id").agg(F.count("*").alias("awaiting_review"))
    return by_document.agg(F.count("*").alias("documents"), F.coalesce(F.sum("awaiting_review"), F.lit(0)).alias("awaiting_review"))


def percent_of_union(overlaps: DataFrame) -> DataFrame:
    """Each part of ``counts.overlaps`` as a whole percent of their sum, halves up; 0 where all are 0."""
    parts = ("defect_only", "handwriting_only", "both")
    union = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    share = lambda p: F.when(union > 0, F.floor(F.col(p) * 100 / union + 0.5)).otherwise(F.lit(0).cast("long")).alias(f"{p}_percent")
    return overlaps.select(union.alias("union"), *map(share, parts))


def user_labels(rows: DataFrame, key: str, users: DataFrame) -> DataFrame:
    """Adds ``label``: a user's full name, else login, else address, else id; an id that no user has stands for itself, none is empty."""
    named = users.select(F.col("id").alias("_id"), F.coalesce(*[F.nullif(c, F.lit("")) for c in ("full_name", "username", "email")], F.col("id").cast("string")).alias("_label"))
    joined = rows.join(named, F.col(key) == F.col("_id"), "left")
    return joined.withColumn("label", F.coalesce("_label", F.col(key).cast("string"), F.lit(""))).drop("_id", "_label")


def report_counters(rows: DataFrame, page_class: str, codes: str) -> DataFrame:
    """Pages of each class and of each code: axis, name, pages. ``codes`` is an array; a code counts once for each time it stands there."""
    names = F.concat(F.array(F.struct(F.lit("class").alias("axis"), F.col(page_class).alias("name"))), F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.struct(F.lit("defect").alias("axis"), c.alias("name"))))
    return rows.select(F.inline(names)).groupBy("axis", "name").agg(F.count("*").alias("pages"))


def archive_manifest(export: DataFrame, names: DataFrame, images: DataFrame) -> DataFrame:
    """Export rows with original_path, annotated_path and a note of what an archive lacks.

    ``names``: page_id, name. ``images``: page_id, stored (a render is known), available (it can be read), annotated; a page without a row has no render.
    """
    rows = export.join(names, "page_id").join(images, "page_id", "left")
    stored, there = F.coalesce("stored", F.lit(False)), F.coalesce("available", F.lit(False))
    path = lambda folder, ok: F.when(ok, F.concat(F.lit(folder), F.col("name"))).otherwise("")
    return rows.select(*export.columns, path("originals/", stored & there).alias("original_path"), path("annotated/", stored & there & F.coalesce("annotated", F.lit(False))).alias("annotated_path"),
                       F.when(~stored, "no stored render for this page version").when(~there, "image unavailable").otherwise("").alias("note"))
