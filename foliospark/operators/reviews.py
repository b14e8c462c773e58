"""Decisions and corrections out of append-only review logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.model import CLOSING_ACTIONS, FLAGGED


def latest_closing(reviews: DataFrame, key: str) -> DataFrame:
    """The newest accept or rescan request of each key, by (created_at, review_id); keys without one have no row."""
    return (reviews.filter(F.col("action").isin(*CLOSING_ACTIONS)).groupBy(key)
            .agg(F.max_by("action", F.struct("created_at", "review_id")).alias("latest_action")))


def effective_class(overall: Column, latest: Column) -> Column:
    """The engine's class, but acceptable where a reviewer's last word on a flagged page was accept; no row: unchecked."""
    return F.when(overall.isin(*FLAGGED) & (latest == "accept"), "acceptable").otherwise(F.coalesce(overall, F.lit("unchecked")))


def review_state(latest: Column) -> Column:
    """accepted, rescan_requested, or pending for pages without a closing decision."""
    return F.when(latest == "accept", "accepted").when(latest == "request_rescan", "rescan_requested").otherwise("pending")


def latest_correction(reviews: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What corrections leave of each key: the last non-empty text, the last qualifier, and the last review that gave either.

    ``reviews`` has action, corrected_text, corrected_qualifier and reviewer; corrections are the actions correct and reject.
    """
    text = F.nullif("corrected_text", F.lit(""))
    when = F.struct(*order)
    rows = reviews.filter(F.col("action").isin("correct", "reject")).withColumns({"_text": text, "_any": text.isNotNull() | F.col("corrected_qualifier").isNotNull()})
    last = lambda value, given: F.max_by(value, F.when(given, when))
    return rows.groupBy(key).agg(
        last("_text", F.col("_text").isNotNull()).alias("text"),
        last("corrected_qualifier", F.col("corrected_qualifier").isNotNull()).alias("qualifier"),
        last("reviewer", F.col("_any")).alias("corrected_by"),
        F.max(F.when(F.col("_any"), when)).getField(order[0]).alias("corrected_at"))


def strongest() -> Column:
    """An aggregate: corrected over confirmed (either closing decision counts) over ai_only."""
    strength = F.max(F.when(F.col("action").isin("correct", "reject", "correct_finding"), 2).when(F.col("action").isin("confirm", *CLOSING_ACTIONS), 1).otherwise(0))
    return F.when(strength == 2, "corrected").when(strength == 1, "confirmed").otherwise("ai_only")


def ai_vs_reviewed(reviews: DataFrame, key: str) -> DataFrame:
    """``strongest`` by all reviews of each key."""
    return reviews.groupBy(key).agg(strongest().alias("ai_vs_reviewed"))
