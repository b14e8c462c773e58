"""Page view, reviews, filters, counts, lists: the invariants that hold on any data."""

import dataclasses
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from foliospark.operators import browse, checks, counts, filters, listing, reviews
from foliospark.operators.filters import PageFilters, day_bound, parse_enum
from foliospark.plans import model
from foliospark.plans.records import core_view, from_tables, versioned
from foliospark.sources import exports


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    return from_tables(spark, sf_dir)


@pytest.fixture(scope="module")
def view(records):
    return core_view(records).cache()


def test_view_has_one_row_per_active_page(records, view):
    assert view.count() == records.versions.count() == view.select("page_id").distinct().count()


def test_buckets_sum_to_the_total_and_name_absence(view):
    rows = {r["effective_class"]: r["pages"] for r in counts.quality_buckets(view).collect()}
    assert set(rows) == set(model.PAGE_CLASSES) and sum(rows.values()) == view.count()
    assert rows["unchecked"] == view.filter("overall IS NULL").count() > 0
    hand = {r["handwriting"]: r["pages"] for r in counts.handwriting_buckets(view).collect()}
    assert set(hand) == set(model.HANDWRITING) and sum(hand.values()) == view.count()


def test_zero_filled_on_no_rows(view):
    assert {r["pages"] for r in counts.quality_buckets(view.limit(0)).collect()} == {0}


def test_each_class_filter_lists_what_the_bucket_counts(view):
    for r in counts.quality_buckets(view).collect():
        assert filters.apply_filters(view, PageFilters(page_class=r["effective_class"])).count() == r["pages"]


def log(spark, rows):
    return spark.createDataFrame([(i, 1, a, datetime(2024, 1, 1, h)) for i, (a, h) in enumerate(rows)], "review_id int, page int, action string, created_at timestamp_ntz")


@pytest.mark.parametrize("rows,engine,klass,state", [
    ([("request_rescan", 1), ("accept", 2)], "rescan", "acceptable", "accepted"),
    ([("accept", 1), ("request_rescan", 2)], "review", "review", "rescan_requested"),
    ([("accept", 1), ("comment", 5)], "review", "acceptable", "accepted"),
    ([("accept", 1), ("request_rescan", 1)], "rescan", "rescan", "rescan_requested"),
    ([("comment", 1)], "failed", "failed", "pending"),
    ([("accept", 1)], "blank", "blank", "accepted"),
    ([("accept", 1)], None, "unchecked", "accepted")])
def test_latest_decision_wins(spark, rows, engine, klass, state):
    last = reviews.latest_closing(log(spark, rows), "page")
    page = spark.createDataFrame([(1, engine)], "page int, overall string").join(last, "page", "left")
    r = page.select(reviews.effective_class(F.col("overall"), F.col("latest_action")).alias("c"), reviews.review_state(F.col("latest_action")).alias("s")).first()
    assert (r["c"], r["s"]) == (klass, state)


def test_rescan_list_follows_decisions(spark):
    pages = spark.createDataFrame([(1, "rescan", None), (2, "rescan", "accept"), (3, "acceptable", "request_rescan"), (4, None, None), (5, "review", None)], "page_id int, overall string, latest_action string")
    assert {r["page_id"] for r in listing.rescan_list(pages).collect()} == {1, 3}


def test_latest_correction_falls_back_field_by_field(spark):
    rows = spark.createDataFrame([(1, "correct", "a", "final", "u", 1), (1, "correct", "", None, "v", 2), (1, "reject", None, "negated", "w", 3), (1, "confirm", "z", "z", "x", 4), (2, "correct", "", None, "u", 1)],
                                 "k int, action string, corrected_text string, corrected_qualifier string, reviewer string, at int")
    found = {r["k"]: tuple(r)[1:] for r in reviews.latest_correction(rows, "k", ["at"]).collect()}
    assert found == {1: ("a", "negated", "w", 3), 2: (None, None, None, None)}


def test_day_bounds():
    assert day_bound("2026-09-16T18:30:00.000Z", True) == datetime(2026, 9, 16, 18, 30, tzinfo=UTC)
    assert day_bound("2026-09-17", True) == datetime(2026, 9, 17, 23, 59, 59, 999999, tzinfo=UTC)
    assert day_bound("2026-09-17", False) == datetime(2026, 9, 17, tzinfo=UTC)
    assert day_bound("2026-09-17 rubbish", False) == datetime(2026, 9, 17, tzinfo=UTC)
    assert day_bound("rubbish", True) is None and day_bound(None, True) is None


def test_local_window_in_utc():
    assert filters.local_window("2026-09-17", "Asia/Kolkata") == ("2026-09-16T18:30:00+00:00", "2026-09-17T18:29:59.999000+00:00")


def test_report_head_lists_what_is_set():
    assert exports.described(PageFilters(page_class="review", defect_code=["BLUR", "DARK"], strict=True)) == [("Page class", "review"), ("Defect code", "BLUR, DARK")]
    assert exports.summary({"files": 3, "quality": {"review": 1, "blank": None}}) == [("files", "3"), ("quality: review", "1"), ("quality: blank", "")]


def test_unknown_enum_values():
    assert parse_enum("review, nonsense", model.PAGE_CLASSES) == ["review"]
    assert parse_enum("nonsense", model.PAGE_CLASSES) is None and parse_enum("nonsense", model.PAGE_CLASSES, strict=True) == []


def test_strict_unknown_class_returns_nothing(view):
    assert filters.apply_filters(view, PageFilters(page_class="nonsense", strict=True)).count() == 0


def test_paging_is_stable(view):
    whole = [r["page_id"] for r in listing.paged(view, 60).collect()]
    assert whole == [r["page_id"] for o in (0, 20, 40) for r in listing.paged(view, 20, o).collect()]
    with pytest.raises(ValueError):
        listing.paged(view, 0)


def test_versions_number_from_the_oldest(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 1)], "k int, at int")
    assert {(r["k"], r["at"]): (r["version_no"], r["is_active"]) for r in versioned(rows, ["k"], ["at"]).collect()} == {(1, 3): (1, False), (1, 5): (2, False), (1, 9): (3, True), (2, 1): (1, True)}


def test_view_plan_has_no_python_and_prunes_columns(records):
    plan = core_view(records).groupBy("effective_class").count()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "lineitem" in line]
    assert scans and all("l_linestatus" not in s.split("ReadSchema")[1] for s in scans)
    analyzed = core_view(records)._jdf.queryExecution().analyzed().toString()
    assert sum("Relation [l_orderkey" in line for line in analyzed.splitlines()) == 1


def test_separate_children_give_the_same_view(records, view):
    apart = dataclasses.replace(records, versions=records.versions.drop("overall", "handwriting_status"), quality=records.versions.filter("overall IS NOT NULL").select("page_id", "overall"),
                                handwriting=records.versions.filter("handwriting_status IS NOT NULL").select("page_id", "handwriting_status"))
    columns = ["page_id", "effective_class", "handwriting", "review_state", "flagged"]
    assert core_view(apart).select(columns).exceptAll(view.select(columns)).isEmpty() and core_view(apart).count() == view.count()


def test_filters_need_their_tables(view):
    for f in (PageFilters(defect_code=["BLUR"]), PageFilters(handwriting="note"), PageFilters(diagnosis_status="pending")):
        with pytest.raises(ValueError, match="needs the table"):
            filters.apply_filters(view, f)
    assert filters.apply_filters(view, PageFilters(batch_id=0)).count() == view.filter("batch_id = 0").count() < view.count()


def test_a_case_without_documents_is_incomplete(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    documents = spark.createDataFrame([(1, "Referral A.pdf", 2)], "case_id long, filename string, pages long")
    items = spark.createDataFrame([("referral", 1, True)], "doc_type string, min_pages int, required boolean")
    coverage = checks.checklist_coverage(documents, items, cases.filter("case_id < 3"))
    assert {r["case_id"]: r["status"] for r in checks.completeness(coverage, cases).collect()} == {1: "verified", 2: "incomplete", 3: "not_verified"}


def test_leaders_depend_on_scan_order(spark):
    rows = spark.createDataFrame([(1, 1, 10, 0), (1, 2, 11, 0b111111), (1, 3, 12, 0b111111111111), (2, 1, 20, 0)], "case_id int, ordinal int, page_id long, hash long")
    assert {r["page_id"]: r["duplicate_of"] for r in checks.leaders(rows).collect()} == {10: None, 11: 10, 12: None, 20: None}


def test_near_pairs_match_brute_force(spark):
    import random

    draw = random.Random(1)
    base = [draw.getrandbits(63) for _ in range(20)]
    hashes = [(i, base[i % 20] ^ (sum(1 << b for b in draw.sample(range(63), draw.randint(0, 9))))) for i in range(80)]
    found = {(r["a"], r["b"], r["distance"]) for r in checks.near_pairs(spark.createDataFrame(hashes, "id long, hash long")).collect()}
    assert found == {(i, j, (x ^ y).bit_count()) for i, x in hashes for j, y in hashes if i < j and (x ^ y).bit_count() <= 6}


def test_gaps_need_three_labels(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 6), (2, 1), (2, 9), (3, None), (4, 2), (4, 3), (4, 4)], "d int, n int")
    assert {r["d"]: (r["n_missing"], r["missing"]) for r in checks.sequence_gaps(rows, "d", "n").collect()} == {1: (3, "3,4,5")}
    labels = spark.createDataFrame([("(12)",), (" 7 ",), ("a3",), (None,), ("",)], "l string").select(checks.printed_number(F.col("l")).alias("n")).collect()
    assert [r["n"] for r in labels] == [12, 7, None, None, None]


def test_exact_duplicates_keep_the_first(spark):
    rows = spark.createDataFrame([(1, "g", "x"), (2, "g", "x"), (3, "h", "x"), (4, "g", "y"), (5, "g", None), (6, "g", "x")], "i int, g string, t string")
    assert {r["i"] for r in checks.exact_duplicates(rows, "g", F.col("t"), ["i"]).collect()} == {2, 6}


def test_printed_labels_answer_a_free_text(view):
    found = filters.apply_filters(view, PageFilters(q=" (2) "))
    assert found.count() == view.filter("printed_label = '(2)'").count() > 0
    assert filters.apply_filters(view.drop("printed_label"), PageFilters(q="(2)")).count() == 0


def test_an_export_of_some_rows(view):
    f = PageFilters(limit=7, offset=3)
    ids = [r["page_id"] for r in view.orderBy(*listing.page_order()).limit(10).collect()][3:]
    assert sorted(r["page_id"] for r in listing.windowed(view, f.limit, f.offset).collect()) == sorted(ids)
    assert listing.windowed(view, None, 3).count() == view.count() == filters.apply_filters(view, f).count()
    assert exports.described(f) == [("Row limit", "7 (offset 3)")]


def _reads(df, column):
    """How many scans of the plan read a column, and how many exchanges deal rows that came from one."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and column in line]
    dealt = 0
    for at in scans:
        low = depth(plan[at])
        for line in reversed(plan[:at]):
            if depth(line) < low:
                low = depth(line)
                dealt += line.lstrip(" :+-*()0123456789").startswith("Exchange")
    return len(scans), dealt


@pytest.mark.parametrize("name", ["page_summary_rows", "export_row", "export_row_private"])
def test_pages_are_read_and_dealt_once(spark, sf_dir, name):
    """Findings, private columns and what belongs to a case don't deal the pages again; children that are small are broadcast."""
    from foliospark.queries import QUERIES

    spark.catalog.clearCache()  # a cached view would stand in for the plan
    assert _reads(QUERIES[name](spark, sf_dir), "l_orderkey") == (1, 1)


def test_versions_are_sorted_once(records):
    assert records.versions._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_findings_of_the_view_or_of_a_table(spark):
    """A view with its own findings gives the rows that a table of findings gives: repeated codes, unknown ones, null ones, none, null."""
    kind = "page_id long, document_id long, version_id long, storage_key string, width int, height int, ordinal int, versions long, overall string, handwriting string, handwriting_status string, batch_id long, batch string, case_id long, patient_ref string, encounter_ref string, filename string, review_state string, uploaded_at timestamp_ntz, findings array<struct<code string, severity string>>"
    found = [[("NOISE", "low"), ("NOISE", "high"), ("BLUR", "medium")], [("OWN", "odd"), (None, "low"), ("BLUR", None)], [], None]
    view = spark.createDataFrame([(i, 1, i, "k", 1, 2, i, 1, "review", "detected", "detected", 1, "b", 1, "p", "e", "f", "pending", None, f) for i, f in enumerate(found)], kind)
    table = view.select("page_id", F.inline("findings"))
    plain = view.drop("findings")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    hand = spark.createDataFrame([(0, "note"), (0, "tick"), (3, "note")], "page_id long, category string")
    status = spark.createDataFrame([(0, "uncertain")], "page_id long, diagnosis_status string")
    read = spark.createDataFrame([(1, "extracted")], "page_id long, prescription_status string")
    own = view.withColumn("prescription_status", F.when(F.col("page_id") == 1, "extracted"))
    assert same(browse.page_summary(own, None, hand, status, None), browse.page_summary(plain, table, hand, status, read))
    said = spark.createDataFrame([(1, "c", "r", "confirmed")], "case_id long, joined string, reviewers string, ai_vs_reviewed string")
    assert same(exports.export_rows(view.join(said, "case_id"), None, None), exports.export_rows(plain, counts.worst_severity(table), said))
    rows = view.select("page_id", "filename", "findings", *exports.PAYLOAD[1:])
    one, other = exports.with_private(rows, None, None, hand, status), exports.with_private(rows.select("page_id", "filename"), plain, table, hand, status)
    assert one.columns == other.columns == ["page_id", "filename", *exports.PRIVATE] and same(one, other)
