"""Screens, settings, enqueue, re-runs and regions on worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliospark.operators import browse, calibration, checks, extract, rules
from foliospark.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_screen_limits():
    assert [browse.screen_limit(k) for k in ("pages", "documents", "cases", "jobs", "recent")] == [200, 100, 50, 100, 20]
    assert browse.screen_limit("jobs", 9999) == 500 and browse.screen_limit("cases", 0) == 1


def test_settings_change_names_what_it_rejects():
    applied, rejected = rules.applied_settings({"noise_sigma": "4", "min_snr": "x", "colour": 1, "blank_component_count": None})
    assert applied["noise_sigma"] == 4.0 and applied["min_snr"] == 12.0 and rejected == ["blank_component_count", "colour", "min_snr"]


def test_unknown_job_state_is_an_error(spark):
    with pytest.raises(ValueError):
        browse.job_list(spark.range(1), "sleeping")


def test_enqueue_returns_revives_and_adds(spark):
    key = jobs.idempotency_key(F.lit("ingest"), F.lit(None), F.col("document_id"))
    at = dt.datetime(2024, 1, 1)
    known = (spark.createDataFrame([(1, "running", 1, None, at), (2, "failed", 3, "late", at), (3, "cancelled", 0, None, at), (4, "failed", 3, "late", at)],
                                   "document_id long, state string, attempt int, error string, queued_at timestamp_ntz")
             .withColumns({"job_key": key, "kind": F.lit("ingest"), "page_id": F.lit(None).cast("long")}))
    asked = spark.createDataFrame([("ingest", None, d, None) for d in (1, 2, 2, 3, 5, 5)] + [("ingest", None, 1, "again")], "kind string, page_id long, document_id long, salt string")
    now = dt.datetime(2024, 2, 1)
    got = jobs.enqueued(known, asked, F.lit(now).cast("timestamp_ntz")).select("document_id", "state", "attempt", "error", "queued_at")
    assert rows(got, "document_id", "state") == [(1, "queued", 0, None, now), (1, "running", 1, None, at), (2, "queued", 0, None, now), (3, "queued", 0, None, now), (4, "failed", 3, "late", at), (5, "queued", 0, None, now)]
    again = jobs.enqueued(jobs.enqueued(known, asked, F.lit(now).cast("timestamp_ntz")), asked, F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz"))
    assert rows(again.select(*got.columns), "document_id", "state") == rows(got, "document_id", "state")
    assert jobs.enqueued(known.limit(0), asked.limit(0), F.lit(now).cast("timestamp_ntz")).count() == 0


def test_strict_date_tells_empty_from_malformed(spark):
    texts = [None, "", "  ", "2024-02-29", "2023-02-29", "20240229", " 2024-01-01 ", "01/02/2024", "2024-1-1", "2024-01-01T00:00"]
    date, bad = checks.strict_date(F.col("t"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", date, bad)
    leap, new_year = dt.date(2024, 2, 29), dt.date(2024, 1, 1)
    assert [r[1:] for r in rows(got, "i")] == [(None, False)] * 3 + [(leap, False), (None, True), (leap, False), (new_year, False)] + [(None, True)] * 3


def test_safety_context_apart_from_region(spark):
    texts = ['{"x": 1, "note": "n", "cleaning_applied": ["a"], "ambiguous_abbreviations": ["MI"]}', '{"note": ""}', None, "not json", "{}"]
    split = browse.safety_context(F.col("t"))
    got = rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *[c.alias(k) for k, c in split.items()]), "i")
    assert got == [(0, {"x": "1"}, "n", ["a"], ["MI"])] + [(i, None, None, [], []) for i in range(1, 5)]


def test_rerun_keeps_what_was_reviewed(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c"), (4, 12, "d")], "extraction_id long, page_id long, text string")
    fresh = spark.createDataFrame([(9, 10, "new")], old.schema)
    reviewed = spark.createDataFrame([(2,), (2,)], "extraction_id long")
    pages = spark.createDataFrame([(10,), (11,)], "page_id long")
    assert rows(extract.replaced(old, reviewed, fresh, pages), "extraction_id") == [(2, 10, "b"), (4, 12, "d"), (9, 10, "new")]


def test_regions_join_words_and_mean_known_confidences(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 40, 20, 0, 0.5, "Take"), (1, 0, 50, 2, 50, 20, 1, None, "twice"), (1, 1, 300, 90, 20, 22, 2, None, "")],
                                  "page_id int, group_no int, x int, y int, w int, h int, order_no int, confidence double, text string")
    got = rows(extract.assembled_regions(words, ["page_id"]).select("group_no", "x", "y", "w", "h", "confidence", "text", "script", "category"), "group_no")
    assert got == [(0, 0, 0, 100, 22, 0.5, "Take twice", "latin", "note"), (1, 300, 90, 20, 22, None, "", "unknown", "tick")]


def test_labels_of_users(spark):
    users = spark.createDataFrame([(1, "Ann", "a", ""), (2, "", "bob", None), (3, None, "", "c@x"), (4, "", None, "")], "id long, full_name string, username string, email string")
    got = browse.user_labels(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, None)], "who long"), "who", users)
    assert rows(got.select("who", "label"), "who") == [(None, ""), (1, "Ann"), (2, "bob"), (3, "c@x"), (4, "4"), (5, "5")]


def test_tuning_needs_five_pages_and_logs_changes(spark):
    at = dt.datetime(2024, 1, 1)
    payload = '{"defect_code": "NOISE", "verdict": "not_a_defect"}'
    reviews = spark.createDataFrame([(i, i, "correct_finding", at, payload) for i in range(5)], "review_id long, page_id long, action string, created_at timestamp_ntz, payload string")
    columns = {m for _, m, _, _ in calibration.TUNABLE}
    metrics = spark.range(5).select(F.col("id").alias("page_id"), *[F.lit(None).cast("double").alias(c) if c != "noise_sigma" else (F.col("id") * 0.1 + 3.05).alias(c) for c in columns])
    steps = calibration.tuning_steps(reviews, metrics, rules.THRESHOLDS)
    assert [tuple(r) for r in steps.collect()] == [("NOISE", "noise_sigma", 3.0, round(3.45 * 1.05, 4), 5)]
    assert calibration.audit_row(steps).collect()[0]["changes"] == {"noise_sigma": round(3.45 * 1.05, 4)}
    few = calibration.tuning_steps(reviews.filter("review_id < 4"), metrics, rules.THRESHOLDS)
    assert few.count() == 0 and calibration.audit_row(few).count() == 0


def test_rescan_rule_is_off_for_a_narrowed_list(spark):
    view = spark.createDataFrame([(1, "rescan", None), (2, "rescan", "accept"), (3, "acceptable", "request_rescan"), (4, "review", None)], "page_id int, overall string, latest_action string")
    assert [r[0] for r in rows(browse.rescan_rows(view, False), "page_id")] == [1, 3]
    assert browse.rescan_rows(view, True).count() == 4


def test_empty_document_has_an_empty_page_list(spark):
    view = spark.createDataFrame([(7, 1, 2, 1, None), (7, 2, 1, 1, "review")], "document_id int, page_id int, ordinal int, versions int, overall string")
    got = rows(browse.document_detail(spark.createDataFrame([(7,), (8,)], "document_id int"), view), "document_id")
    assert [tuple(p) for p in got[0][1]] == [(1, 2, 1, "review"), (2, 1, 1, "unchecked")] and got[1] == (8, [])


def test_manifest_says_what_is_missing(spark):
    export = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    names = export.withColumn("name", F.lit("p.png"))
    images = spark.createDataFrame([(1, True, True, True), (2, True, False, True)], "page_id int, stored boolean, available boolean, annotated boolean")
    got = rows(browse.archive_manifest(export, names, images), "page_id")
    assert got == [(1, "originals/p.png", "annotated/p.png", ""), (2, "", "", "image unavailable"), (3, "", "", "no stored render for this page version")]
