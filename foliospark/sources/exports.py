"""Exports: the wide row, CSV files, archive names, an XLSX workbook."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import safe_part
from foliospark.operators import keyed
from foliospark.operators.listing import windowed
from foliospark.operators.rules import DEFECTS, LABELS
from foliospark.plans.model import SEVERITIES, at_rank, rank

# Columns of an export in order, with their headings.
EXPORT = {
    "batch": "Batch", "patient_ref": "Patient ref", "encounter_ref": "Encounter ref", "filename": "File", "page_no": "Page", "printed_label": "Printed label", "version": "Version", "scan_status": "Scan status",
    "defect_codes": "Defect codes", "defect_severities": "Defect severities", "handwriting_status": "Handwriting", "handwriting_categories": "Handwriting categories", "diagnosis_status": "Diagnosis status",
    "diagnosis_qualifier": "Diagnosis qualifier", "diagnosis_text_raw": "Diagnosis text (AI, raw)", "diagnosis_text_reviewed": "Diagnosis text (reviewer corrected)", "reviewed_by": "Reviewed by",
    "reviewer_comment": "Reviewer comment", "ai_vs_reviewed": "AI vs reviewed"}
CELL = 32_000
# The private columns, and the view's columns that the first six are made of.
PRIVATE = ("_page_version_id", "_logical_page_id", "_document_id", "_storage_key_render", "_width", "_height", "_quality_findings", "_handwriting_regions", "_diagnosis_regions")
PAYLOAD = ("page_id", "document_id", "version_id", "storage_key", "width", "height")


def export_rows(view: DataFrame, severities: DataFrame | None, reviewed: DataFrame | None, diagnoses: DataFrame | None = None, categories: DataFrame | None = None,
                limit: int | None = None, offset: int = 0) -> DataFrame:
    """One row per active page for reports, with the columns of ``EXPORT``. Children are aggregated by their key first and joined once each.

    ``scan_status`` is the engine's class, not the effective one, so an accepted page still shows what was measured.

    * ``severities``: page_id, code, severity (the worst of each code). None: of the view's array ``findings``, without a join.
    * ``reviewed``: case_id, joined (comments), reviewers, ai_vs_reviewed (see ``operators.reviews.ai_vs_reviewed``). None: the view has these columns.
    * ``diagnoses``: page_id, diagnosis_status, qualifiers, raw, corrected. Without a row: pending, and no texts.
    * ``categories``: page_id, labels. A page's ``printed_label`` is taken from the view if that has it.
    * ``limit``, ``offset``: only these rows of the view's page order (``listing.windowed``); children are joined to them alone.
    """
    view = windowed(view, limit, offset)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(DEFECTS) for x in (c, i)])
    place = lambda code: F.coalesce(F.try_element_at(order, code), F.lit(999)).alias("place")
    if severities is None:
        worst = lambda c: at_rank(F.array_max(F.transform("findings", lambda f: F.when(f["code"].eqNullSafe(c), rank(f["severity"], SEVERITIES)))), SEVERITIES)
        rows = view.withColumn("_d", F.sort_array(F.transform(F.array_distinct("findings.code"), lambda c: F.struct(place(c), c.alias("code"), worst(c).alias("severity")))))
    else:
        defects = severities.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(place(F.col("code")), "code", "severity"))).alias("_d"))
        rows = view.join(defects, "page_id", "left")
    rows = rows if reviewed is None else rows.join(reviewed, "case_id", "left")
    rows = rows.join(diagnoses, "page_id", "left") if diagnoses is not None else rows.withColumns({c: F.lit(None).cast("string") for c in ("diagnosis_status", "qualifiers", "raw", "corrected")})
    rows = rows.join(categories, "page_id", "left") if categories is not None else rows.withColumn("labels", F.lit(None).cast("string"))
    text = lambda f: F.coalesce(F.array_join(F.transform("_d", lambda x: x[f]), "; "), F.lit(""))
    plain = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return rows.select(
        "page_id", plain("batch", "batch"), plain("patient_ref", "patient_ref"), plain("encounter_ref", "encounter_ref"), "filename", F.col("ordinal").alias("page_no"),
        plain("printed_label" if "printed_label" in view.columns else F.lit(None).cast("string"), "printed_label"), F.col("versions").alias("version"), F.coalesce("overall", F.lit("unchecked")).alias("scan_status"),
        text("code").alias("defect_codes"), text("severity").alias("defect_severities"), F.col("handwriting").alias("handwriting_status"), plain("labels", "handwriting_categories"),
        F.coalesce("diagnosis_status", F.lit("pending")).alias("diagnosis_status"), plain("qualifiers", "diagnosis_qualifier"), plain("raw", "diagnosis_text_raw"), plain("corrected", "diagnosis_text_reviewed"),
        plain("reviewers", "reviewed_by"), plain("joined", "reviewer_comment"), F.coalesce("ai_vs_reviewed", F.lit("ai_only")).alias("ai_vs_reviewed"))


def with_private(rows: DataFrame, view: DataFrame | None, findings: DataFrame | None, regions: DataFrame, extractions: DataFrame) -> DataFrame:
    """Export rows (with ``page_id``) with the nine private columns that archives and checklists work from; ``public`` strips them.

    * ``view``: page_id, document_id, version_id, storage_key, width, height. None: ``rows`` has these columns, which then don't stay under their own names.
    * ``findings``: page_id, code, severity, and if known detail, source, confidence, region. None: the array ``findings`` of ``rows``, likewise.
    * ``regions``: page_id, category, and if known confidence, polygon.
    * ``extractions``: page_id, diagnosis_status, and if known anchor_label, region.

    A page's children are few; each table is gathered by page once. Lists are sorted, and empty where a page has none.
    """

    def gathered(table: DataFrame, name: str, fields: dict[str, tuple[str, str]], **more: Column) -> DataFrame:
        of = lambda column, kind: F.col(column) if column in table.columns else F.lit(None).cast(kind)
        item = F.struct(*[of(c, kind).alias(f) for f, (c, kind) in fields.items()], *[c.alias(f) for f, c in more.items()])
        return table.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias(name))

    label = lambda code: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), code), code)
    fault = {"defect_code": ("code", "string"), "severity": ("severity", "string"), "detail": ("detail", "string"), "source": ("source", "string"),
             "confidence": ("confidence", "double"), "region": ("region", "string")}
    taken = {*(PAYLOAD[1:] if view is None else ()), *(("findings",) if findings is None else ())}
    kept = [c for c in rows.columns if c not in taken]
    if findings is None:
        known = rows.schema["findings"].dataType.elementType.names
        faults = F.sort_array(F.transform("findings", lambda x: F.struct(*[(x[c] if c in known else F.lit(None).cast(kind)).alias(f) for f, (c, kind) in fault.items()], label(x["code"]).alias("label"))))
        rows = rows.withColumn("_quality_findings", F.coalesce(faults, F.array().cast(rows.select(faults).schema[0].dataType)))
    children = (
        gathered(findings, "_quality_findings", fault, label=label(F.col("code"))) if findings is not None else None,
        gathered(regions, "_handwriting_regions", {"category": ("category", "string"), "confidence": ("confidence", "double"), "polygon": ("polygon", "array<array<double>>")}),
        gathered(extractions, "_diagnosis_regions", {"status": ("diagnosis_status", "string"), "anchor_label": ("anchor_label", "string"), "region": ("region", "string")}))
    payload = [F.col("version_id").alias("_page_version_id"), F.col("page_id").alias("_logical_page_id"), F.col("document_id").alias("_document_id"),
               F.col("storage_key").alias("_storage_key_render"), F.col("width").alias("_width"), F.col("height").alias("_height")]
    faulty = ["_quality_findings"] if findings is None else []
    out = rows.select(*kept, *payload, *faulty) if view is None else rows.select(*kept, *faulty).join(view.select("page_id", *payload), "page_id").select(*kept, *PRIVATE[:6], *faulty)
    for child in filter(None, children):
        name = child.columns[1]
        out = out.join(child, "page_id", "left").withColumn(name, F.coalesce(name, F.array().cast(child.schema[name].dataType)))
    return out


def public(df: DataFrame) -> DataFrame:
    """Without private columns, those that begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with CRLF line ends and a header each, in the table's order of columns: the bulk form of an export."""
    df.write.option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def csv_chunks(df: DataFrame, headings: dict[str, str]) -> Iterator[bytes]:
    """One CSV file for a spreadsheet: UTF-8 with a mark, CRLF, minimal quotes; rows stream through the driver a partition at a time."""
    names = [c for c in headings if c in df.columns]
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\r\n")
    writer.writerow([headings[c] for c in names])
    yield b"\xef\xbb\xbf" + buffer.getvalue().encode()
    for row in df.select(*names).toLocalIterator():
        buffer.seek(0)
        buffer.truncate()
        writer.writerow(["" if v is None else v for v in row])
        yield buffer.getvalue().encode()


def archive_names(pages: DataFrame) -> DataFrame:
    """A file name of each page in an archive; a name that is taken gets ``__2``, ``__3``, ... in page order.

    Names are numbered over ranges of (name, page), so that a name that many pages share isn't one task's work.
    """
    base = F.concat_ws("/", safe_part(F.col("batch"), "batch"), safe_part(F.col("filename"), "file"), F.format_string("p%04d_v%d", "ordinal", "versions"))
    named = keyed.numbered(pages.select("page_id", base.alias("_base")), ["_base"], ["page_id"], "_n")
    return named.select("page_id", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("__"), F.col("_n"))).otherwise(""), F.lit(".png")).alias("name"))


def xlsx(df: DataFrame, headings: dict[str, str], parameters: dict[str, str], most: int = 100_000) -> bytes:
    """A workbook of two sheets, for screens of up to ``most`` rows (more is an error: use ``write_csv``)."""
    names = [c for c in headings if c in df.columns]
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write CSV")

    def sheet(lines: list[list]) -> str:
        cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v if len(v) <= CELL else v[: CELL - 1] + "…")}</t></is></c>'
        body = "".join("<row>" + "".join(cell("" if v is None else str(v)) for v in line) + "</row>" for line in lines)
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Report parameters" sheetId="1" r:id="r1"/><sheet name="Pages" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([[k, v] for k, v in parameters.items()]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([[headings[c] for c in names], *map(list, rows)]))
    return out.getvalue()


def summary(totals: dict) -> list[tuple[str, str]]:
    """Nested totals as label and value lines, in their order."""
    out = []
    for name, value in totals.items():
        if isinstance(value, dict):
            out += [(f"{name}: {label}", text) for label, text in summary(value)]
        else:
            out.append((name, "" if value is None else str(value)))
    return out


def described(filters) -> list[tuple[str, str]]:
    """The filters that are set, as lines of a report's head."""
    window = [("Row limit", f"{filters.limit} (offset {filters.offset})")] if filters.limit else []
    return [(name.replace("_", " ").capitalize(), ", ".join(value) if isinstance(value, list) else str(value))
            for name, value in vars(filters).items() if value and name not in ("strict", "limit", "offset")] + window
