"""The record hierarchy batch - case - document - page - version, and its joined view with one row per active page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.reviews import effective_class, latest_closing, review_state
from foliospark.plans.model import FLAGGED


@dataclass(frozen=True)
class Records:
    """Tables of the hierarchy. A page without a row in ``quality`` or ``handwriting`` was never looked at.

    Where these two are None, ``versions`` has their columns itself (``overall``, ``handwriting_status``; null: never looked at), and no join is needed.
    ``versions`` may also have ``findings``, an array of (code, severity): what reads a page's findings then needn't deal pages and ``findings`` by page.
    """

    batches: DataFrame  # batch_id, batch
    cases: DataFrame  # case_id, batch_id, patient_ref, encounter_ref
    documents: DataFrame  # document_id, case_id, filename, uploaded_at, uploader, status
    versions: DataFrame  # page_id, document_id, ordinal, version_no, is_active and what was measured
    quality: DataFrame | None  # page_id, overall
    findings: DataFrame  # page_id, code, severity
    handwriting: DataFrame | None  # page_id, handwriting_status
    reviews: DataFrame  # review_id, case_id, action, created_at, payload, value


def versioned(rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """Number the versions of each key from the oldest on and mark the newest as active."""
    old = Window.partitionBy(*key).orderBy(*newest)
    new = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumns({"version_no": F.row_number().over(old), "is_active": F.row_number().over(new) == 1})


def active(rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """The newest version of each key; ``versions`` counts all. One shuffle and one sort by key; a key has few versions."""
    whole = Window.partitionBy(*key)
    place = F.row_number().over(whole.orderBy(*[F.desc_nulls_last(c) for c in newest]))
    placed = rows.withColumn("_place", place)  # first: the count then finds the rows of a key together, and doesn't sort them again
    return placed.withColumn("versions", F.count("*").over(whole)).filter("_place = 1").drop("_place")


def from_tables(spark: SparkSession, sf_dir: str) -> Records:
    """The hierarchy as the order tables hold it: nations are batches, customers cases, orders documents, order lines pages."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lines = table("lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"),
        F.col("l_shipdate").alias("shipped"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    # dealt and sorted by document once: the window, its page numbers and the join to documents all keep to that
    pages = active(lines.repartition("document_id"), ["document_id", "ordinal"], ["shipped", "part", "supplier", "price"])
    pages = pages.select((F.col("document_id") * 100 + F.col("ordinal")).alias("page_id"), "*")
    overall = (F.when(F.col("discount") >= 0.09, "rescan").when(F.col("discount") >= 0.06, "review")
               .when(F.col("tax") == 0, "blank").when(F.col("tax") >= 0.08, "failed").otherwise("acceptable"))
    shot = F.col("discount") > 0
    found = F.array_compact(F.array(
        F.when(F.col("discount") >= 0.06, F.struct(F.lit("BLUR").alias("code"), F.when(F.col("discount") >= 0.09, "high").otherwise("medium").alias("severity"))),
        F.when(shot & (F.col("tax") >= 0.06), F.struct(F.lit("NOISE").alias("code"), F.lit("medium").alias("severity"))),
        F.when(shot & (F.col("quantity") < 5), F.struct(F.lit("NEAR_BLANK").alias("code"), F.lit("low").alias("severity")))))
    pages = pages.withColumns({
        "overall": F.when(shot, overall), "findings": found, "handwriting_status": F.when(F.col("flag") == "R", "detected").when(F.col("flag") != "N", "none_detected"),
        "version_id": F.col("page_id") * 100 + F.col("versions"), "printed_label": F.when(F.col("ordinal") % 3 != 0, F.format_string("(%d)", "ordinal")),
        "width": 1240 + F.col("part") % 100, "height": 1754 + F.col("supplier") % 50, "storage_key": F.format_string("renders/%d.png", "page_id"),
        "colour_mode": F.when(F.col("part") % 3 == 0, "bitonal").when(F.col("part") % 3 == 1, "grey").otherwise("colour"),
        "capture_profile": F.when(F.col("supplier") % 2 == 0, "photo").otherwise("flatbed"), "quality_score": F.when(shot, F.col("quantity") * 2)})
    events = table("events")
    actions = F.create_map(*[F.lit(x) for p in (("purchase", "accept"), ("error", "request_rescan"), ("click", "correct_finding"), ("view", "comment")) for x in p])
    return Records(
        table("nation").select(F.col("n_nationkey").alias("batch_id"), F.col("n_name").alias("batch")),
        table("customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("batch_id"), F.col("c_name").alias("patient_ref"), F.col("c_mktsegment").alias("encounter_ref")),
        table("orders").select(
            F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("case_id"), F.format_string("scan_%d.pdf", "o_orderkey").alias("filename"),
            F.col("o_orderdate").alias("uploaded_at"), F.col("o_orderpriority").alias("uploader"), F.col("o_orderstatus").alias("status")),
        pages,
        None,
        pages.select("page_id", F.inline("findings")),
        None,
        events.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("case_id"), F.coalesce(actions[F.col("event_type")], F.col("event_type")).alias("action"),
                      F.col("ts").alias("created_at"), F.col("props").alias("payload"), F.col("value")))


def core_view(r: Records, of_case: DataFrame | None = None) -> DataFrame:
    """One row per active page with what lists, counts and exports filter on.

    Only joins to one row: nothing fans out. Quality and handwriting are left joins, so that absence stays visible as null;
    ``effective_class`` and ``handwriting`` name it (unchecked, pending). What belongs to a case is joined to its documents first, which are far fewer than
    pages; ``of_case`` (case_id and other columns, one row each) adds columns that way.
    """
    pages = r.versions
    for child in (r.quality, r.handwriting):
        pages = pages if child is None else pages.join(child, "page_id", "left")
    documents = r.documents.join(r.cases, "case_id", "left").join(latest_closing(r.reviews, "case_id"), "case_id", "left")
    documents = (documents if of_case is None else documents.join(of_case, "case_id", "left")).join(r.batches, "batch_id", "left")
    joined = pages.join(documents, "document_id")
    return joined.withColumns({
        "effective_class": effective_class(F.col("overall"), F.col("latest_action")),
        "review_state": review_state(F.col("latest_action")),
        "handwriting": F.coalesce("handwriting_status", F.lit("pending")),
        "flagged": F.coalesce(F.col("overall").isin(*FLAGGED), F.lit(False))})
