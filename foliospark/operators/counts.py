"""Counts on several axes. A missing result is counted under its own name, and every value of a domain gets a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.model import HANDWRITING, JOB_STATES, PAGE_CLASSES, at_rank, rank, zero_filled


def quality_buckets(view: DataFrame) -> DataFrame:
    """Active pages in each effective class."""
    return zero_filled(view.groupBy("effective_class").agg(F.count("*").alias("pages")), "effective_class", "pages", PAGE_CLASSES)


def handwriting_buckets(view: DataFrame) -> DataFrame:
    return zero_filled(view.groupBy("handwriting").agg(F.count("*").alias("pages")), "handwriting", "pages", HANDWRITING)


def priority(status: str, order: tuple[str, ...]) -> Column:
    """An aggregate: the status that is first in ``order``."""
    return at_rank(F.min(rank(F.col(status), order)), order)


def priority_status(rows: DataFrame, key: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """One status of each key: the first in ``order``."""
    return rows.groupBy(key).agg(priority(status, order).alias(status))


def priority_buckets(keys: DataFrame, rows: DataFrame, key: str, status: str, order: tuple[str, ...], absent: str = "pending") -> DataFrame:
    """Keys under each status of ``order``; keys without rows count as ``absent``."""
    one = keys.select(key).join(priority_status(rows, key, status, order), key, "left")
    return zero_filled(one.groupBy(F.coalesce(status, F.lit(absent)).alias(status)).agg(F.count("*").alias("pages")), status, "pages", order)


def awaiting_review(view: DataFrame) -> DataFrame:
    """Flagged pages without a closing decision."""
    return view.filter(F.col("flagged") & F.col("latest_action").isNull()).agg(F.count("*").alias("pages"))


def job_counts(jobs: DataFrame, pages: DataFrame, documents: DataFrame, states: tuple[str, ...] = JOB_STATES) -> DataFrame:
    """Jobs in each state that belong to one of the pages or to one of the documents."""
    of_page = jobs.join(pages.select(F.col("page_id")).distinct(), "page_id", "left_semi")
    of_document = jobs.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    mine = of_page.select("job_id", "state").unionByName(of_document.select("job_id", "state")).distinct()
    return zero_filled(mine.groupBy("state").agg(F.count("*").alias("jobs")), "state", "jobs", states)


def overlaps(view: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with defects only, handwriting only and both, in one pass over flags."""
    defective = findings.select("page_id").distinct().withColumn("_defect", F.lit(True))
    flags = view.select("page_id", (F.col("handwriting") == "detected").alias("_hand")).join(defective, "page_id", "left")
    d = F.coalesce("_defect", F.lit(False))
    return flags.agg(F.count_if(d & ~F.col("_hand")).alias("defect_only"), F.count_if(~d & F.col("_hand")).alias("handwriting_only"), F.count_if(d & F.col("_hand")).alias("both"))


def defect_breakdown(view: DataFrame, findings: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Distinct pages of each code with its place in the report: most pages first, then the codes' own order."""
    seen = findings.join(view.select("page_id"), "page_id", "left_semi").distinct()
    counted = seen.groupBy("code").agg(F.countDistinct("page_id").alias("pages")).withColumn("code_order", F.coalesce(rank(F.col("code"), order), F.lit(len(order))))
    return counted.orderBy(F.desc("pages"), "code_order", "code")


def batch_rollup(batches: DataFrame, cases: DataFrame, documents: DataFrame, view: DataFrame) -> DataFrame:
    """Documents and active pages of each batch; empty batches have zeros."""
    pages = view.groupBy("document_id").agg(F.count("*").alias("pages"))
    counted = (documents.join(pages, "document_id", "left").join(cases.select("case_id", "batch_id"), "case_id")
               .groupBy("batch_id").agg(F.count("*").alias("documents"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages")))
    return batches.join(counted, "batch_id", "left").select("batch_id", "batch", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("pages", F.lit(0)).alias("pages"))


def case_rollup(cases: DataFrame, documents: DataFrame, view: DataFrame) -> DataFrame:
    """Counts of each case and its first page by (uploaded_at, ordinal, page_id)."""
    docs = documents.groupBy("case_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "P").alias("pending"), F.count_if(F.col("status") == "F").alias("finished"))
    pages = view.groupBy("case_id").agg(
        F.count("*").alias("pages"), F.count("overall").alias("measured"), F.min_by("page_id", F.struct("uploaded_at", "ordinal", "page_id")).alias("first_page"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cases.join(docs, "case_id", "left").join(pages, "case_id", "left").select("case_id", *map(zero, ("documents", "pending", "finished", "pages", "measured")), "first_page")


def document_class_counts(view: DataFrame) -> DataFrame:
    """Pages of each document and effective class, measured pages only."""
    return view.filter("overall IS NOT NULL").groupBy("document_id", "effective_class").agg(F.count("*").alias("pages"))


def document_class_map(view: DataFrame) -> DataFrame:
    """``document_class_counts`` as one map per document."""
    pairs = F.sort_array(F.collect_list(F.struct("effective_class", "pages")))
    return document_class_counts(view).groupBy("document_id").agg(F.map_from_entries(pairs).alias("classes"))


def worst_severity(findings: DataFrame) -> DataFrame:
    """The worst severity of each page and code."""
    order = ("low", "medium", "high")
    return findings.groupBy("page_id", "code").agg(F.max(rank(F.col("severity"), order)).alias("_r")).select("page_id", "code", at_rank(F.col("_r"), order).alias("severity"))


def counted_labels(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Labels of each key in order, with `` xN`` from two on, joined by ``; ``."""
    text = F.concat("_l", F.when(F.col("_n") > 1, F.concat(F.lit(" x"), F.col("_n"))).otherwise(""))
    return (rows.filter(F.col(label).isNotNull()).groupBy(key, F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
            .groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_l", text.alias("_t")))), lambda x: x["_t"]), "; ").alias("labels")))


def joined(value: Column, order: list[str], separator: str, distinct: bool) -> Column:
    """An aggregate: values in the order of ``order``, joined; repeated ones once if so asked. Nulls are skipped."""
    items = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))), lambda x: x["_v"])
    return F.array_join(F.array_distinct(items) if distinct else items, separator)


def ordered_join(rows: DataFrame, key: str, value: Column, order: list[str], separator: str, distinct: bool) -> DataFrame:
    """``joined`` values of each key."""
    return rows.groupBy(key).agg(joined(value, order, separator, distinct).alias("joined"))


def percent_of_max(counts: DataFrame, count: str) -> DataFrame:
    """Whole percent of the largest count, halves up; the maximum is a scalar subquery."""
    top = counts.agg(F.max(count)).scalar()
    return counts.withColumn("percent", F.when(top > 0, F.floor(F.col(count) * 100 / top + 0.5)).otherwise(0))


def elapsed(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Longest time from start to end of each key in seconds; null where nothing has ended."""
    seconds = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return rows.groupBy(key).agg(F.max(seconds).alias("seconds"))

