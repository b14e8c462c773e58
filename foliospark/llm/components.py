"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import attach_groups, written


def _stars(links: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: each node's neighbours (large: the greater ones; small: the smaller ones and itself) point to its least neighbour. ``total``: about how many links."""
    rows = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        rows = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = attach_groups(rows, least, "u", "n", total)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter("a <> b").distinct()


def _open(links: DataFrame) -> tuple[int, bool]:
    """How many links there are, and whether some don't lead from a node to its component's least node at once."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    nodes = ends.groupBy("node").agg(F.sum("from").alias("out"), F.max("to").alias("in"))
    found = nodes.agg(F.sum("out"), F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0)))).first()
    return found[0] or 0, bool(found[1])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node that links reach) of every node with a link to another.

    ``links`` has bigint columns a and b; nulls and links of a node to itself are left out. Each step is written to the shared folder.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        total, open_ = _open(links)
        if not open_:
            break
        links = written(_stars(links, True, total), "stars")
        links = written(_stars(links, False, total), "stars")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
