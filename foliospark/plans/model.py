"""Domains of the status columns, in the order in which counts list them, and their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The domains of the record model.
PAGE_CLASSES = ("acceptable", "review", "rescan", "blank", "failed", "unchecked")
SEVERITIES = ("low", "medium", "high")
HANDWRITING = ("none_detected", "detected", "failed", "unsupported", "pending")
HANDWRITING_CATEGORIES = ("signature", "note", "correction", "tick", "stamp", "uncertain")
DIAGNOSIS = ("extracted_pending_review", "uncertain", "unreadable", "processing_failed", "not_found", "unconfigured", "pending")
#: The order in which a page list picks one of a page's diagnosis statuses; the dashboard's is that of ``DIAGNOSIS``.
DIAGNOSIS_LIST_ORDER = ("processing_failed", "unreadable", "uncertain", "extracted_pending_review", "unconfigured", "pending", "not_found")
JOB_STATES = ("queued", "running", "succeeded", "failed", "cancelled")
FLAGGED = ("review", "rescan")
CLOSING_ACTIONS = ("accept", "request_rescan")


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in its domain; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]), value)


def at_rank(position: Column, order: tuple[str, ...]) -> Column:
    """The domain's value at a position; null outside."""
    return F.get(F.array(*[F.lit(v) for v in order]), position)


def domain(spark: SparkSession, name: str, order: tuple[str, ...]) -> DataFrame:
    """A row for each value, with its position: what zero-filled counts are joined from."""
    values = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias(name)) for i, v in enumerate(order)])
    return spark.range(1).select(F.inline(values))


def zero_filled(counts: DataFrame, name: str, count: str, order: tuple[str, ...]) -> DataFrame:
    """One row for each value of the domain, 0 where ``counts`` has none. Values outside of the domain are left out."""
    return (domain(counts.sparkSession, name, order).join(F.broadcast(counts), name, "left")  # counts: a row per value
            .select(name, F.coalesce(count, F.lit(0)).alias(count)))
