"""Ordered lists: paging, queues, the rescan list, files with their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_order() -> list:
    return [F.desc_nulls_last("uploaded_at"), F.asc_nulls_last("document_id"), F.asc_nulls_last("ordinal")]


def paged(view: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One screen of a list: an ordered limit, which Spark runs as a top-k, not a full sort."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset not negative")
    return view.orderBy(*page_order()).offset(offset).limit(limit)


def windowed(view: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """The rows of a bounded export: as many as asked for in page order, without a maximum; without a limit all rows, whatever the offset."""
    return view.orderBy(*page_order()).offset(max(offset, 0)).limit(limit) if limit else view


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)


def rescan_list(view: DataFrame) -> DataFrame:
    """Pages to scan again: the engine says so and no reviewer accepted, or a reviewer's last word asks for it."""
    engine = (F.col("overall") == "rescan") & ~F.col("latest_action").eqNullSafe("accept")
    return view.filter(F.coalesce(engine, F.lit(False)) | F.col("latest_action").eqNullSafe("request_rescan"))


def by_file(view: DataFrame) -> DataFrame:
    """Files of each batch with their pages in order; ``first_ordinal`` orders files as the list did."""
    return view.groupBy("batch", "filename").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "page_id"))), lambda p: p["ordinal"].cast("string")), ",").alias("pages"), F.min("ordinal").alias("first_ordinal"))


def next_open(view: DataFrame) -> DataFrame:
    """For each page the next page of its document that awaits review."""
    ahead = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    is_open = F.col("flagged") & F.col("latest_action").isNull()
    return view.withColumn("next_open", F.min(F.when(is_open, F.col("ordinal"))).over(ahead)).select("page_id", "document_id", "ordinal", "next_open")
