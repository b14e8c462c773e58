"""Profiles of tables that somebody else designed: columns, lengths, formats, paths, keys that don't agree in type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, non-null values, distinct values, least and largest (as text) of each column. Distinct counts are exact."""
    aggregates = []
    for c in columns:
        aggregates += [F.count(c).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}")]
    one = df.agg(F.count("*").alias("rows"), *aggregates)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows"), F.col(f"n_{c}").alias("non_null"), F.col(f"d_{c}").alias("distinct"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("largest")) for c in columns])))


def lengths(df: DataFrame, text: Column) -> DataFrame:
    """Rows of each text length, whether any has a digit, a slash or a dash, and the first and last example."""
    return (df.select(text.alias("t")).filter("t IS NOT NULL").groupBy(F.length("t").alias("length"))
            .agg(F.count("*").alias("rows"), F.bool_or(F.col("t").rlike("[0-9]")).alias("digits"), F.bool_or(F.col("t").contains("/")).alias("slashes"),
                 F.bool_or(F.col("t").contains("-")).alias("dashes"), F.min("t").alias("first"), F.max("t").alias("last")))


def unparseable(df: DataFrame, text: Column, kind: str) -> DataFrame:
    """Values, those that don't read as ``kind``, and the sum of those that do (numbers)."""
    value = text.try_cast(kind)
    return df.agg(F.count(text).alias("values"), F.count_if(text.isNotNull() & value.isNull()).alias("unparseable"), F.sum(text.try_cast("bigint")).alias("total"))


def overlap_of_types(left: DataFrame, number: str, right: DataFrame, text: str) -> DataFrame:
    """How many numbers of the left occur as texts on the right, by one equality join on distinct keys."""
    a = left.select(F.col(number).cast("string").alias("k")).filter("k IS NOT NULL").distinct()
    b = right.select(F.col(text).alias("k")).filter("k IS NOT NULL").distinct()
    return a.join(b, "k", "left_semi").agg(F.count("*").alias("matching"))


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: one union of partial counts."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def catalog_columns(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of each column: what an information schema lists."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
