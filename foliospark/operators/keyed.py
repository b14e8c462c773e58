"""Joins and numbering by keys of which one may hold a large share of all rows, and tables that cut a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of all rows counts as hot, so that there are fewer hot keys than its inverse.
HOT = 1000
#: The low bits of ``monotonically_increasing_id`` number the rows of a partition.
_PLACE = 33


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can read and write: ``spark.checkpoint.dir``, or, on a local master only, a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/foliospark-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what is computed from it doesn't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to one row for each key, whose other columns are attached. ``groups`` has ``key``, ``size`` (rows of the key) and these.

    Hot keys (fewer than ``HOT``) are broadcast and their rows stay where they are; all others are dealt by key. Rows with a null in the key get nulls.
    """
    bound = max(1, total // HOT)
    attached = [c for c in groups.columns if c not in (*key, size)]
    hot = groups.filter(F.col(size) > bound).drop(size).withColumn("_hot", F.lit(True))
    first = rows.join(F.broadcast(hot), key, "left")
    dealt = first.filter(F.col("_hot").isNull()).drop("_hot", *attached).join(groups.filter(F.col(size) <= bound).drop(size).hint("shuffle_hash"), key, "left")
    stay = first.filter(F.col("_hot").isNotNull()).drop("_hot")
    return stay.unionByName(dealt.select(stay.columns))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """Adds each row's number within its key, from 1 in ``order``, like a window does, but a key's rows may lie in many tasks.

    Rows are dealt in ranges of (key, order). A row's place in all is its place in its range plus the sizes of the ranges before; its number is that
    less the first place of its key. Nulls of a key are one key.
    """
    spread = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*key, *order, "_salt").drop("_salt")
    sorted_ = written(spread.sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _PLACE)
    before, offsets = 0, []
    for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each task
        offsets.append((r["part"], before))
        before += r["n"]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    placed = (sorted_.withColumn("_part", part).join(table, "_part", "left")
              .withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))).drop("_part", "_before"))
    safe = [F.struct(F.col(c)).alias(f"_key_{i}") for i, c in enumerate(key)]  # structs of a null are equal
    keyed, names = placed.select("*", *safe), [f"_key_{i}" for i in range(len(key))]
    firsts = written(keyed.groupBy(*names).agg(F.min("_at").alias("_first"), F.count("*").alias("_size")), "firsts")
    return attach(keyed, firsts, names, "_size", before).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *names)


def in_force(rows: DataFrame, at: str, changes: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """As-of join: ``rows`` with a map ``thresholds`` of all ``defaults`` as they were at each row's time ``at``.

    ``changes``: changed_at, change_id, threshold, value. The last change at or before the time counts, of equal times that with the largest id; changes of
    other names, without a time or without a value are none. Rows without a time get the defaults.

    Rows and changes are dealt together in ranges of time, a change before the rows of its time. The last value of each name is carried on within a range by a
    window; what held when a range began are the last values of the ranges before it, a row for each range. So the work is a sort, however many changes and rows
    fall on one day or one moment.
    """
    names, spark = sorted(defaults), rows.sparkSession
    log = changes.filter(F.col("threshold").isin(names) & F.col("changed_at").isNotNull() & F.col("value").isNotNull())
    value = lambda n: F.when(F.col("threshold") == n, F.col("value").cast("double"))
    time = rows.schema[at].dataType
    marks = log.select(F.col("changed_at").cast(time).alias("_at"), F.col("change_id").alias("_change"), *[value(n).alias(f"_v{i}") for i, n in enumerate(names)],
                       F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    own = rows.select(F.col(at).alias("_at"), F.lit(None).cast(changes.schema["change_id"].dataType).alias("_change"), *[F.lit(None).cast("double").alias(f"_v{i}") for i in range(len(names))], F.struct("*").alias("_row"))
    place = [F.col("_at").asc_nulls_first(), F.col("_row").isNotNull(), F.col("_change")]
    dealt = marks.unionByName(own).withColumn("_salt", F.when(F.col("_row").isNotNull(), F.monotonically_increasing_id()))
    dealt = written(dealt.repartitionByRange(*place, "_salt").withColumn("_part", F.spark_partition_id()), "in-force")
    last = [F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.struct("_at", "_change"))).alias(f"_o{i}") for i in range(len(names))]
    now, openings = [None] * len(names), []
    for r in dealt.groupBy("_part").agg(*last).orderBy("_part").collect():  # a row for each range
        openings.append((r["_part"], *now))
        now = [r[f"_o{i}"] if r[f"_o{i}"] is not None else v for i, v in enumerate(now)]
    held = spark.createDataFrame(openings, ", ".join(["_part int", *[f"_o{i} double" for i in range(len(names))]]))
    upto = Window.partitionBy("_part").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.drop("_salt").withColumns({f"_l{i}": F.last(f"_v{i}", ignorenulls=True).over(upto) for i in range(len(names))}).filter("_row IS NOT NULL").join(F.broadcast(held), "_part", "left")
    thresholds = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.coalesce(f"_l{i}", f"_o{i}", F.lit(float(defaults[n]))))])
    return met.select("_row.*", F.when(F.col("_at").isNotNull(), thresholds).otherwise(F.create_map(*[F.lit(x) for n in names for x in (n, float(defaults[n]))])).alias("thresholds"))
