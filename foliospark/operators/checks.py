"""Completeness checks: copies, gaps in page numbers, checklist coverage."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import keyed

HAMMING = 6


def exact_duplicates(documents: DataFrame, group: str, content: Column, order: list[str]) -> DataFrame:
    """Copies within a group, by SHA-256: all rows but the first of each content.

    The first of each content is found by a pre-aggregated minimum, and attached so that contents with a large share of all rows stay dealt as they
    are. Rows with a null group or content are no copies.
    """
    rows = documents.withColumn("_hash", F.sha2(content.cast("binary"), 256))
    firsts = rows.filter(F.col(group).isNotNull() & F.col("_hash").isNotNull()).groupBy(group, "_hash").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_size")).filter("_size > 1")
    found = keyed.attach(rows, firsts, [group, "_hash"], "_size", documents.count())
    return found.filter(F.struct(*order) > F.col("_first")).drop("_hash", "_first")


def sign_hash(vector: Column, bits: int = 63) -> Column:
    """Signs of the first components as a bigint: a perceptual hash of a vector."""
    part = F.slice(vector, 1, bits)
    return F.aggregate(F.sequence(F.lit(0), F.size(part) - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.when(F.get(part, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))


def near_pairs(hashes: DataFrame, most: int = HAMMING, bits: int = 63, agree: int | None = None, group: str | None = None) -> DataFrame:
    """Pairs (a < b) of ids whose hashes differ in at most ``most`` bits; with ``group`` only pairs of the same one. Null hashes have none.

    Exact: of most + ``agree`` bands, ``agree`` are equal in two such hashes, so that sets of so many bands are joined by equality. More bands make
    keys longer, and so fewer pairs that only look alike, for more rows a hash: 7 keys of 9 bits, 28 of 14, or 84 of 21. By default the number of rows chooses.
    """
    if agree is None:
        n = hashes.count()
        agree = 1 if n < 20_000 else 2 if n < 2_000_000 else 3
    number = most + agree
    cuts = [i * bits // number for i in range(number + 1)]
    band = [F.shiftrightunsigned("hash", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.concat_ws(",", *[band[j].cast("string") for j in chosen]).alias("part")) for i, chosen in enumerate(combinations(range(number), agree))])
    own = [group] if group else []
    rows = hashes.filter(F.col("hash").isNotNull()).select("id", "hash", *own, F.inline(keys))
    on = [*own, "which", "part"]
    a, b = rows.select(F.col("id").alias("a"), F.col("hash").alias("ha"), *on), rows.select(F.col("id").alias("b"), F.col("hash").alias("hb"), *on)
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    # merge: each hash becomes up to 84 rows, which the size of the table before doesn't show, so that Spark would gather them all in the driver for a broadcast
    return a.join(b.hint("merge"), on).filter((F.col("a") < F.col("b")) & (distance <= most)).select("a", "b", distance.alias("distance")).distinct()


def leaders(pages: DataFrame, most: int = HAMMING) -> DataFrame:
    """Near duplicates in scan order: each page of a case is a leader, or ``duplicate_of`` the first leader before it within ``most`` bits.

    ``pages`` has case_id, ordinal, page_id (unique) and hash; order is by ordinal, then page_id. Pages with a null hash or case are leaders.

    Equal hashes of a case are one node, their first page: the others follow it. Nodes settle in rounds, all cases at once: an open node without an open
    node before it among its neighbours is a leader, and its later neighbours are duplicates. The links are those of ``near_pairs`` within cases, each round is
    written to the shared folder, and rounds are as many as the longest chain of pages that depend on each other in turn.
    """
    order = F.struct("ordinal", "page_id")
    known = pages.filter(F.col("hash").isNotNull() & F.col("case_id").isNotNull())
    def dealt(table: DataFrame) -> DataFrame:
        """For joins: files of ids are small, but a broadcast of them unpacks them in the driver, once for each round."""
        return table.hint("merge")

    nodes = keyed.written(known.groupBy("case_id", "hash").agg(F.min(order).alias("first"), F.count("*").alias("size")), "nodes")
    named = nodes.select("case_id", F.col("first.page_id").alias("id"), "hash", "first")
    pairs = near_pairs(named, most, group="case_id").select("a", "b")
    place = named.select("id", "first")
    links = (pairs.join(dealt(place.select(F.col("id").alias("a"), F.col("first").alias("fa"))), "a").join(dealt(place.select(F.col("id").alias("b"), F.col("first").alias("fb"))), "b"))
    early, late = F.when(F.col("fa") < F.col("fb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a"))
    links = keyed.written(links.select(early.alias("early"), late.alias("late")), "links")
    left, settled, rounds = links, [], 0
    while not left.isEmpty():
        lead = left.select(F.col("early").alias("id")).distinct().join(dealt(left.select(F.col("late").alias("id"))), "id", "left_anti")
        lead = keyed.written(lead, f"lead-{rounds}")
        gone = left.join(dealt(lead.withColumnRenamed("id", "early")), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        gone = keyed.written(gone, f"gone-{rounds}")
        settled.append(gone)
        out = lead.unionByName(gone)
        left = keyed.written(left.join(dealt(out.withColumnRenamed("id", "early")), "early", "left_anti").join(dealt(gone.withColumnRenamed("id", "late")), "late", "left_anti"), f"left-{rounds}")
        rounds += 1
    duplicates = settled[0] if settled else named.select("id").limit(0)
    for more in settled[1:]:
        duplicates = duplicates.unionByName(more)
    leading = links.join(dealt(duplicates.withColumnRenamed("id", "early")), "early", "left_anti").join(dealt(place.withColumnRenamed("id", "early")), "early")
    of = leading.join(dealt(duplicates.withColumnRenamed("id", "late")), "late", "left_semi").groupBy("late").agg(F.min("first").alias("leader"))
    found = nodes.join(dealt(of.select(F.col("late").alias("_id"), F.col("leader.page_id").alias("leader"))), nodes["first.page_id"] == F.col("_id"), "left")
    found = keyed.written(found.select("case_id", "hash", "size", F.col("first.page_id").alias("first"), "leader"), "settled")
    rows = keyed.attach(known.select("case_id", "hash", "page_id"), found, ["case_id", "hash"], "size", pages.count())
    rest = pages.filter(F.col("hash").isNull() | F.col("case_id").isNull()).select("page_id", F.lit(None).cast("long").alias("duplicate_of"))
    own = F.when(F.col("page_id") == F.col("first"), F.col("leader")).otherwise(F.coalesce("leader", "first"))
    return rows.select("page_id", own.alias("duplicate_of")).unionByName(rest)


def printed_number(label: Column) -> Column:
    """The number of a printed label such as ``(12)``; null for others."""
    return F.regexp_extract(F.btrim(label, F.lit("() ")), r"^(\d{1,9})$", 1).try_cast("int")


def sequence_gaps(labels: DataFrame, key: str, number: str, least: int = 3, shown: int = 50) -> DataFrame:
    """Numbers missing between the least and the largest of each key with ``least`` distinct numbers or more."""
    seen = labels.filter(F.col(number).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(number)).alias("seen")).filter(F.size("seen") >= least)
    missing = F.array_except(F.sequence(F.array_min("seen"), F.array_max("seen")), F.col("seen"))
    return seen.select(key, missing.alias("missing")).filter(F.size("missing") > 0).select(key, F.size("missing").alias("n_missing"), F.array_join(F.slice("missing", 1, shown), ",").alias("missing"))


def checklist_coverage(documents: DataFrame, items: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Pages that each case has of each checklist item, and what is wrong with it.

    ``cases`` (case_id) are those with the checklist; without documents they have no page of any item. By default all cases with documents have it.

    An item covers the documents whose name holds its doc_type (any case). The checklist is configuration: a short list that becomes
    expressions. ``documents``: case_id, filename, pages. ``items``: doc_type, min_pages, required.
    """
    wanted = items.orderBy("doc_type").collect()
    stem = F.lower(F.regexp_replace("filename", r"\.[^.]*$", ""))
    counted = documents.groupBy("case_id").agg(*[F.sum(F.when(stem.contains(w["doc_type"].lower()), F.col("pages")).otherwise(0)).alias(f"_{i}") for i, w in enumerate(wanted)])
    if cases is not None:
        counted = cases.select("case_id").join(counted, "case_id", "left")
    rows = F.array(*[F.struct(F.lit(w["doc_type"]).alias("doc_type"), F.coalesce(f"_{i}", F.lit(0)).alias("pages"), F.lit(w["min_pages"]).alias("min_pages"), F.lit(w["required"]).alias("required")) for i, w in enumerate(wanted)])
    problem = F.when(F.col("required") & (F.col("pages") == 0), "missing").when((F.col("pages") > 0) & (F.col("pages") < F.col("min_pages")), "too_few").otherwise("ok")
    return counted.select("case_id", F.inline(rows)).withColumn("state", problem)


def completeness(coverage: DataFrame, cases: DataFrame) -> DataFrame:
    """not_verified without a checklist, incomplete if something is missing, else verified."""
    worst = coverage.groupBy("case_id").agg(F.bool_or(F.col("state") != "ok").alias("_bad"))
    return cases.select("case_id").join(worst, "case_id", "left").select("case_id", F.when(F.col("_bad").isNull(), "not_verified").when(F.col("_bad"), "incomplete").otherwise("verified").alias("status"))


def retention_due(documents: DataFrame, now: Column, days: int) -> DataFrame:
    """Documents older than ``days``; 0 turns the sweep off."""
    return documents.filter(F.lit(days > 0) & (F.col("uploaded_at") < now - F.make_dt_interval(F.lit(days))))


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The least value at which half of a key's weight is reached."""
    w = Window.partitionBy(key).orderBy(value)
    total = Window.partitionBy(key)
    return (rows.withColumns({"_c": F.sum(weight).over(w), "_t": F.sum(weight).over(total)}).filter(F.col("_c") * 2 >= F.col("_t"))
            .groupBy(key).agg(F.min(value).alias("median")))



# What a case's completeness is called.
COMPLETENESS_LABELS = {"verified": "Complete against the attached checklist", "incomplete": "Incomplete against the attached checklist", "not_verified": "Completeness not verified"}


def completeness_label(status: Column) -> Column:
    """The words for a status; a case that was never checked is not verified."""
    words = F.create_map(*[F.lit(x) for pair in COMPLETENESS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, status), F.lit(COMPLETENESS_LABELS["not_verified"]))


def strict_date(text: Column) -> tuple[Column, Column]:
    """(date, malformed) of a field: an empty one is null and fine, one that is no ISO date is null and malformed."""
    value = F.regexp_replace(text, r"^\s+|\s+$", "")
    iso = value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})$")
    date = F.when(iso, F.try_to_date(F.replace(value, F.lit("-"), F.lit("")), "yyyyMMdd"))
    return date, F.coalesce((value != "") & date.isNull(), F.lit(False))
