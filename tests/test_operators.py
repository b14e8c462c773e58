"""Rules, tuning, extraction, recognised text, files, exports, measurement, jobs, registered queries."""

import csv
import io
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import calibration, extract, measure, profiling, rules
from foliospark.queries import ORACLES, QUERIES
from foliospark.sources import exports, files, ocr
from foliospark.streaming import jobs

CLEAN = dict(
    width=1240, height=1754, error=None, is_bitonal=False, ink_paper_contrast=150.0, median_luma=240.0, stroke_sharpness=3.9, noise_sigma=0.5, snr=300.0, text_ink_coverage=0.09, ink_coverage=0.09, text_component_count=430,
    est_text_height_px=23.0, skew_deg=0.0, rotation_deg=0, rotation_confidence=0.0, tile_count=30, low_contrast_tiles=0, glare_area_fraction=0.0, shadow_area_fraction=0.0, illumination_ratio=1.0, cutoff_edges=[])
SCHEMA = ("width int, height int, error string, is_bitonal boolean, ink_paper_contrast double, median_luma double, stroke_sharpness double, noise_sigma double, snr double, text_ink_coverage double, ink_coverage double, "
          "text_component_count int, est_text_height_px double, skew_deg double, rotation_deg int, rotation_confidence double, tile_count int, low_contrast_tiles int, glare_area_fraction double, shadow_area_fraction double, "
          "illumination_ratio double, cutoff_edges array<string>")

RULES = [
    ({}, "acceptable", []), ({"stroke_sharpness": 0.9}, "rescan", ["BLUR:high"]), ({"stroke_sharpness": 1.5}, "review", ["BLUR:medium"]), ({"ink_paper_contrast": 20.0}, "rescan", ["FAINT:high"]),
    ({"ink_paper_contrast": 60.0}, "review", ["LOW_CONTRAST:medium"]), ({"median_luma": 60.0}, "rescan", ["DARK:high"]), ({"tile_count": 10, "low_contrast_tiles": 6}, "rescan", ["UNREADABLE_REGION:high"]),
    ({"rotation_deg": 90, "rotation_confidence": 0.8}, "rescan", ["ROTATED:high"]), ({"skew_deg": -8.0}, "rescan", ["SKEWED:high"]), ({"skew_deg": 2.0}, "acceptable", ["SKEWED:low"]), ({"is_bitonal": True, "stroke_sharpness": 0.5}, "review", ["BITONAL_LOSS:medium"]),
    ({"width": 0}, "failed", []), ({"error": "x"}, "failed", []), ({"text_ink_coverage": 0.001, "text_component_count": 3}, "blank", []), ({"text_ink_coverage": 0.001, "median_luma": 20.0}, "rescan", ["DARK:high"]),
    ({"cutoff_edges": ["left"]}, "review", ["SUSPECTED_CUTOFF:medium"]), ({"cutoff_edges": ["left", "left", "top"]}, "rescan", ["SUSPECTED_CUTOFF:high"]), ({"est_text_height_px": 5.0, "shadow_area_fraction": 0.2}, "review", ["SHADOW:medium", "LOW_RESOLUTION:medium"])]


def test_rules_case_by_case(spark):
    rows = spark.createDataFrame([tuple((CLEAN | change).values()) for change, _, _ in RULES], SCHEMA)
    for r, (change, overall, found) in zip(rules.judge(rows).collect(), RULES, strict=True):
        assert (r["overall"], [f"{f['code']}:{f['severity']}" for f in r["findings"]]) == (overall, found), change
    severe = rules.judge(rows.limit(2), {"rescan_severity_score": 99, "unknown": 1}).collect()
    assert severe[1]["overall"] == "rescan" and severe[0]["thresholds_hash"] == rules.thresholds_hash(rules.merged({"rescan_severity_score": 99}))


def test_provider_findings_add_up(spark):
    rows = rules.judge(spark.createDataFrame([tuple((CLEAN | {"rotation_deg": 90, "rotation_confidence": 0.8}).values())], SCHEMA))
    rows = rows.withColumn("provider_defects", F.from_json(F.lit('[{"type":"quality/defect_noisy","confidence":0.5},{"type":"other","confidence":1}]'), "array<struct<type:string,confidence:double>>"))
    r = rules.with_provider(rows, rotation_checked=True).first()
    assert [(f["code"], f["severity"], f["source"]) for f in r["findings"]] == [("NOISE", "medium", "provider")] and r["overall"] == "review"


@pytest.mark.parametrize("values,samples,expected", [([2.0] * 3, 3, None), ([2.0] * 6, 6, 1.875), ([0.2] * 6, 0, None), ([1.6, 1.6, 1.6, 1.6, 1.6, 9.0], 6, 1.68)])
def test_tuning_is_bounded(spark, values, samples, expected):
    r = calibration.next_value(spark.createDataFrame([(v,) for v in values], "v double"), "v", 1.5, calibration.BOUNDS["skew_deg"], "higher_bad").first()
    assert (r["samples"], r["threshold"]) == (samples, expected)


def test_extraction_of_one_page(spark):
    lines = ["Patient: X", "Provisional Diagnosis: Acute appendicitis; r/o TB", "ICD code K35.8", "Final Diagnosis", "known case of DM", "and HTN", "Date 1.1.2020", "Department of Radio-Diagnosis", "Impression:", "TLC, DLC, ESR"]
    page = spark.createDataFrame([(1, t, 60.0, 40.0 * i, 30.0, 0.5 if i == 1 else 0.9) for i, t in enumerate(lines)], "page_id long, text string, x double, y double, height double, confidence double")
    found = [(r["raw_text"], r["qualifier"], r["status"], r["icd"]) for r in extract.entries(extract.labelled_values(page)).collect()]
    assert found == [("Acute appendicitis", "provisional", "uncertain", "K35.8"), ("r/o TB", "ruled_out", "uncertain", "K35.8"), ("known case of DM", "past_history", "extracted_pending_review", None),
                     ("HTN", "final", "extracted_pending_review", None), (None, "unspecified", "not_found", None)]


PENDING = "extracted_pending_review"
VALUES = [
    (["Diagnosis: History of TB"], [("History of TB", PENDING)]),  # only following lines are looked at for form fields
    (["Diagnosis", "Date 1.1.2020"], [(None, "not_found")]),
    ([("Diagnosis", 0), ("Anaemia", 60), ("Malaria", 105), ("Typhoid", 106)], [("Anaemia\nMalaria", PENDING)]),  # 2.5 heights from the label's lower end
    (["Diagnosis", "  ", "", "Anaemia"], [("Anaemia", PENDING)]),  # blank lines are left out
    (["Diagnosis: x", "Anaemia"], [("x\nAnaemia", PENDING)]),  # one character is no value
    (["Diagnosis:", "Anaemia", "Department of Radio-Diagnosis"], [("Anaemia", PENDING)]),  # such a line ends a value
    (["Diagnosis: TLC, DLC, ESR"], []), (["Diagnosis: TLC; Anaemia"], [("TLC", PENDING), ("Anaemia", PENDING)]), (["Diagnosis", "TLC, DLC"], [(None, "not_found")]),
    (["Diagnosis: ;"], [(None, "not_found")]), (["nothing here"], []), (["Impression - Fever and chills"], [("Fever", PENDING), ("chills", PENDING)])]


def test_labelled_values(spark):
    rows = []
    for i, (lines, _) in enumerate(VALUES):
        step = 25.0 if "  " in lines else 40.0
        rows += [(i, t, 60.0, float(y), 30.0, 0.9) for t, y in [x if isinstance(x, tuple) else (x, step * n) for n, x in enumerate(lines)]]
    page = spark.createDataFrame(rows, "page_id long, text string, x double, y double, height double, confidence double")
    found: dict = {}
    for r in extract.entries(extract.labelled_values(page)).collect():
        found.setdefault(r["page_id"], []).append((r["raw_text"], r["status"]))
    for i, (lines, expected) in enumerate(VALUES):
        assert sorted(found.get(i, []), key=str) == sorted(expected, key=str), lines


def test_labelled_regions(spark):
    rows = [(1, "Final Diagnosis", 50.0, 10.0, 30.0, 0.9, 100.0), (1, "Anaemia", 40.0, 50.0, 30.0, 0.4, 200.0), (1, "ICD D64", 40.0, 90.0, 30.0, 0.9, 50.0), (2, "ICD X10", 0.0, 0.0, 9.0, 0.1, 1.0)]
    page = spark.createDataFrame(rows, "page_id long, text string, x double, y double, height double, confidence double, width double")
    r = extract.labelled_values(page).collect()
    assert [tuple(x) for x in r] == [(1, "Final Diagnosis", "final", "Anaemia", 0.4, "D64", 40.0, 10.0, 200.0, 70.0)]


def test_word_groups_and_categories(spark):
    words = spark.createDataFrame([(1, 0, 0, 30), (1, 35, 2, 30), (1, 200, 0, 30), (1, 0, 60, 10)], "p int, x int, y int, w int")
    assert sorted((r["x"], r["y"], r["group_no"]) for r in extract.word_groups(words, ["p"], F.lit(20.0)).collect()) == [(0, 0, 0), (0, 60, 2), (35, 2, 0), (200, 0, 1)]
    c, p = extract.region_category(F.col("n"), F.col("w"), F.col("h"))
    shapes = spark.createDataFrame([(1, 20, 20), (3, 100, 20), (0, 200, 50), (5, 100, 50), (20, 100, 50), (2, 0, 9)], "n int, w int, h int").select(c.alias("c")).collect()
    assert [r["c"] for r in shapes] == ["tick", "correction", "signature", "uncertain", "note", "uncertain"]
    flags = spark.createDataFrame([([],), ([None, False],), ([False],), ([None, True],)], "f array<boolean>").select(extract.handwriting_status(F.col("f")).alias("s")).collect()
    assert [r["s"] for r in flags] == ["failed", "unsupported", "none_detected", "detected"]


def test_recognised_text(spark):
    r = spark.range(1).select(
        ocr.anchored_text(F.lit("Hello world"), F.from_json(F.lit('[{"start":0,"end":5},{"start":6,"end":8}]'), "array<struct<start:int,end:int>>")).alias("t"),
        ocr.snapped(F.lit(359.0)).alias("a"), ocr.snapped(F.lit(-100.0)).alias("b"), ocr.snapped(F.lit(45.0)).alias("c"),
        ocr.prescription_status(ocr.reasoning(F.lit("not json"))).alias("bad"), ocr.prescription_status(ocr.reasoning(F.lit('{"medicines":[],"summary":"This is not a prescription."}'))).alias("none"),
        ocr.needs_confirmation(ocr.reasoning(F.lit('{"medicines":[{"name":"x","confidence":"low"}],"uncertainties":[]}'))).alias("ask")).first()
    assert tuple(r) == ("Hellowo", 0, 270, 0, "failed", "not_a_prescription", True)
    answers = ["{\"medicines\":[", "5", "null", "", None, "[]", '{"medicines":[{"name":"x","confidence":"high"}]}', ' {"summary":"other"}']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    assert [x["s"] for x in rows.orderBy("i").select(ocr.prescription_status(ocr.reasoning(F.col("a"))).alias("s")).collect()] == ["failed"] * 6 + ["extracted"] * 2


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n/Type /Page\n/Type/Page \n/Type /Pages\n%%EOF")
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "d.tif").write_bytes(b"II*\0" + (8).to_bytes(4, "little") + (0).to_bytes(2, "little") + (14).to_bytes(4, "little") + (0).to_bytes(2, "little") + (0).to_bytes(4, "little"))
    (tmp_path / "e.jpg").write_bytes(b"nonsense")
    scanned = files.scan(spark, str(tmp_path))
    assert {r["filename"]: r["reason"] for r in scanned.collect()} == {"a.pdf": None, "b.exe": "unsupported_type", "d.tif": None, "e.jpg": None}
    assert {r["path"][-5:]: (r["pages"], r["warning"]) for r in files.probed(scanned).collect()} == {"a.pdf": (2, None), "d.tif": (2, None), "e.jpg": (0, "corrupted")}
    sizes = spark.createDataFrame([("a.pdf", 0), ("a.PDF", files.MAX_BYTES + 1), ("a", 5), ("a.png", 5)], "n string, s long").select(files.validated(F.col("n"), F.col("s")).alias("r")).collect()
    assert [r["r"] for r in sizes] == ["empty", "too_large", "unsupported_type", None]
    assert [r["l"] for r in spark.createDataFrame([("(3)",), ("12",), ("x",)], "t string").select(files.printed_label(F.col("t")).alias("l")).collect()] == ["(3)", "(12)", None]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b", "line\nbreak", 'q"x'), ("c", None, "y,z")], "batch string, filename string, patient_ref string")
    data = b"".join(exports.csv_chunks(df, exports.EXPORT))
    assert data.startswith(b"\xef\xbb\xbfBatch,Patient ref,File\r\n") and b"\r\n" in data
    assert list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))[1] == ["b", 'q"x', "line\nbreak"]
    with zipfile.ZipFile(io.BytesIO(exports.xlsx(df, exports.EXPORT, {"from": "x"}))) as z:
        assert b"Patient ref" in z.read("xl/worksheets/sheet2.xml")
    exports.write_csv(df, str(tmp_path / "out"))
    names = exports.archive_names(spark.createDataFrame([(i, "A b/", "x..", 1, 2) for i in range(3)], "page_id int, batch string, filename string, ordinal int, versions int")).orderBy("page_id").collect()
    assert [r["name"] for r in names] == ["A_b/x/p0001_v2.png", "A_b/x/p0001_v2__2.png", "A_b/x/p0001_v2__3.png"]
    assert exports.public(df.withColumn("_x", F.lit(1))).columns == df.columns


def test_text_functions(spark):
    r = spark.range(1).select(
        text.shortened(F.lit("abcdef  gh"), 8).alias("a"), text.shortened(F.lit("ab\rc"), 9).alias("b"), text.safe_part(F.lit(" ../é "), "f").alias("c"), text.script(F.lit("abc अ")).alias("d"), text.stripped(F.lit("\t a \n")).alias("e"),
        text.redacted(F.create_map(F.lit("Text"), F.lit("x"), F.lit("k"), F.lit("y" * 121)), ("text",)).alias("f"), text.joined_key(F.lit("a"), F.lit(None), F.lit("b")).alias("g")).first()
    assert tuple(r)[:5] == ("abcdef…", "ab c", "f", "mixed", "a")
    import hashlib

    assert r["f"] == {"Text": "<redacted>", "k": "<redacted:long-string>"} and r["g"] == hashlib.sha256(b"a||b").hexdigest()


def page_image(shade=30, paper=246, blur=0):
    x = np.full((400, 300), paper, np.uint8)
    draw = np.random.default_rng(1)
    for top in range(30, 370, 20):
        for left in range(20, 270, 12):
            x[top:top + 10, left:left + draw.integers(3, 9)] = shade
    y = x.astype(float)
    for _ in range(blur):
        y = (np.roll(y, 1, 0) + np.roll(y, -1, 0) + np.roll(y, 1, 1) + np.roll(y, -1, 1) + y) / 5
    return y.astype(np.uint8)


def test_measurements_are_ordered_and_pure():
    x = page_image()
    before = x.copy()
    sharp = [measure.measure(page_image(blur=b))["stroke_sharpness"] for b in (0, 2, 6)]
    assert sharp[0] > sharp[1] > sharp[2] > 0
    assert measure.measure(x)["ink_paper_contrast"] > measure.measure(page_image(shade=180))["ink_paper_contrast"]
    noisy = np.clip(x + np.random.default_rng(2).normal(0, 8, x.shape), 0, 255).astype(np.uint8)
    assert measure.measure(noisy)["noise_sigma"] > measure.measure(x)["noise_sigma"]
    assert (x == before).all() and measure.measure(x) == measure.measure(x)
    blank = measure.measure(np.full((200, 150), 250, np.uint8))
    assert blank["text_ink_coverage"] == 0 and blank["text_component_count"] == 0
    for odd in (np.zeros((1, 1), np.uint8), np.zeros((300, 3), np.uint8), np.zeros((50, 50), np.uint8)):
        measure.measure(odd)
    a, b = measure.perceptual_hash(x.astype(float)), measure.perceptual_hash(noisy.astype(float))
    assert (a ^ b).bit_count() <= 12


def test_broken_images_are_rows(spark):
    good = b"P5 300 400 255\n" + page_image().tobytes()
    rows = spark.createDataFrame([(1, good), (2, b"nonsense"), (3, good[:50]), (4, None)], "page_id long, content binary")
    found = {r["page_id"]: r for r in rules.judge(measure.measured(rows)).collect()}
    assert found[1]["error"] is None and found[1]["overall"] != "failed" and all(found[i]["overall"] == "failed" and found[i]["error"] for i in (2, 3, 4))


EVENTS = [("a", "enqueue"), ("a", "claim"), ("a", "fail"), ("a", "claim"), ("a", "succeed"), ("a", "cancel"), ("b", "claim"), ("b", "enqueue"), ("b", "claim"), ("b", "fail"), ("b", "claim"), ("b", "stalled"), ("b", "claim"), ("b", "fail"),
          ("c", "enqueue"), ("c", "cancel"), ("c", "enqueue"), ("d", "heartbeat")]
ENDS = {"a": ("succeeded", 1), "b": ("failed", 3), "c": ("queued", 0), "d": (None, 0)}


def test_job_log_replay(spark):
    rows = spark.createDataFrame([(k, e, datetime(2024, 1, 1, 0, i), i) for i, (k, e) in enumerate(EVENTS)], "job_key string, event string, at timestamp_ntz, event_id int")
    assert {r["job_key"]: (r["state"], r["attempt"]) for r in jobs.replayed(rows).collect()} == ENDS
    by: dict = {}
    for k, e in EVENTS:
        by[k] = jobs.step(*by.get(k, (None, 0)), e)
    assert by == ENDS


def test_job_sweep_and_fan_out(spark):
    now = datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(1, "running", 0, datetime(2024, 1, 1, 11, 50)), (2, "running", 0, datetime(2024, 1, 1, 11)), (3, "running", 2, None), (4, "queued", 0, None)], "j int, state string, attempt int, heartbeat_at timestamp_ntz")
    assert {r["j"]: (r["state"], r["attempt"]) for r in jobs.stalled_sweep(rows, F.lit(now).cast("timestamp_ntz")).collect()} == {1: ("running", 0), 2: ("queued", 1), 3: ("failed", 3), 4: ("queued", 0)}
    pages = spark.range(2).withColumnRenamed("id", "page_id")
    assert jobs.fan_out(pages).count() == 6 and jobs.fan_out(pages, ()).count() == 0


def test_export_columns(spark):
    view = spark.createDataFrame([(1, 7, "b", None, None, "f.pdf", 3, 2, "rescan", "detected"), (2, 8, None, "p", "e", "g.pdf", 1, 1, None, "pending")],
                                 "page_id long, case_id long, batch string, patient_ref string, encounter_ref string, filename string, ordinal int, versions int, overall string, handwriting string")
    severities = spark.createDataFrame([(1, "NEAR_BLANK", "low"), (1, "BLUR", "high"), (1, "OTHER", "low")], "page_id long, code string, severity string")
    reviewed = spark.createDataFrame([(7, "c | d", "A; B", "corrected")], "case_id long, joined string, reviewers string, ai_vs_reviewed string")
    found = {r["page_id"]: r for r in exports.export_rows(view, severities, reviewed).collect()}
    assert list(found[1].asDict())[1:] == list(exports.EXPORT)
    assert (found[1]["defect_codes"], found[1]["defect_severities"], found[1]["ai_vs_reviewed"], found[1]["reviewed_by"]) == ("BLUR; NEAR_BLANK; OTHER", "high; low; low", "corrected", "A; B")
    assert (found[2]["scan_status"], found[2]["diagnosis_status"], found[2]["ai_vs_reviewed"], found[2]["batch"]) == ("unchecked", "pending", "ai_only", "")


def test_profiles(spark):
    df = spark.createDataFrame([(1, "12"), (2, "x"), (3, None)], "a int, b string")
    assert tuple(profiling.unparseable(df, F.col("b"), "bigint").first()) == (2, 1, 12)
    assert profiling.overlap_of_types(df, "a", spark.createDataFrame([("1",), ("01",)], "t string"), "t").first()[0] == 1
    assert profiling.catalog_columns(df)[0][:2] == ("a", "int")


def test_some_queries_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("quality_buckets_effective", "overlap_counts", "case_rollup_first_page", "export_row", "rule_engine_findings", "sequence_gaps", "checklist_coverage", "gap_groups", "stalled_sweep"):
        df = QUERIES[name](spark, sf_dir)
        columns = sorted(df.columns)
        theirs = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall()
        ours = [tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()]
        assert sorted(map(repr, ours)) == sorted(map(repr, theirs)), name


def test_labelled_entries_read_whole_lines(spark, tmp_path):
    line = "fever with chills since the monsoon and no relief from earlier tablets; r/o sepsis of unknown origin"
    spark.createDataFrame([(1, "one\ntwo\nthree\n" + line + "\nfive")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r["raw_text"], r["qualifier"]) for r in QUERIES["labelled_entries"](spark, str(tmp_path)).collect()]
    assert found == [("fever with chills since the monsoon", "provisional"), ("no relief from earlier tablets", "provisional"), ("r/o sepsis of unknown origin", "ruled_out")]


def test_answers_of_a_wrong_type_fail_and_doubt_is_kept(spark):
    answers = {'{"medicines":"x"}': ("failed", None), '{"medicines":["x"]}': ("failed", None), '{"medicines":[],"uncertainties":"x"}': ("failed", None), '{"medicines":[{"confidence":"high"},1]}': ("failed", None),
               '{"needs_confirmation":false}': ("extracted", False), '{"medicines":null,"needs_confirmation":false}': ("extracted", False), '{"medicines":[]}': ("extracted", True),
               '{"needs_confirmation":false,"medicines":[{"name":"x","confidence":"high"}],"uncertainties":[]}': ("extracted", False),
               '{"needs_confirmation":false,"medicines":[{"name":"x"}]}': ("extracted", True), '{"needs_confirmation":false,"uncertainties":["dose"]}': ("extracted", True), "x": ("failed", None)}
    rows = spark.createDataFrame([(a,) for a in answers], "a string").withColumn("r", ocr.reasoning(F.col("a")))
    got = rows.select("a", ocr.prescription_status(F.col("r")).alias("s"), ocr.needs_confirmation(F.col("r")).alias("c")).collect()
    assert {x["a"]: (x["s"], x["c"]) for x in got} == answers


def test_notes_and_regions_of_entries(spark):
    kind = "page_id long, text string, x double, y double, height double, confidence double, width double, handwritten boolean"
    lines = [(1, "Final Diagnosis", 50.0, 10.0, 30.0, 0.9, 100.0, None), (1, "Anaemia; TB", 40.0, 50.0, 30.0, 0.9, 200.0, True), (2, "Diagnosis: Malaria", 0.0, 0.0, 9.0, 0.5, 80.0, False),
             (3, "Diagnosis: 12345 67", 0.0, 0.0, 9.0, None, 80.0, False), (4, "Diagnosis", 0.0, 0.0, 9.0, 0.9, 80.0, True), (5, "Diagnosis: Typhoid", 0.0, 0.0, 9.0, 0.125, 80.0, False), (6, "Diagnosis: Fever", 0.0, 0.0, 9.0, None, 80.0, None)]
    found = {(r["page_id"], r["raw_text"]): r for r in extract.entries(extract.labelled_values(spark.createDataFrame(lines, kind))).collect()}
    hand = "Handwritten source — confirm the transcription against the image."
    kept = "Contains abbreviations that were left exactly as written and not expanded: TB."
    assert {key: r["note"] for key, r in found.items()} == {
        (1, "Anaemia"): hand, (1, "TB"): f"{hand} {kept}", (2, "Malaria"): "Low provider confidence (0.50). Confirm against the image before use.",
        (3, "12345 67"): "Not transcribed with confidence: transcription is mostly non-alphabetic characters. Read the highlighted region on the image.",
        (4, None): "A diagnosis label is present on the page but no value was read next to it.",
        (5, "Typhoid"): "Not transcribed with confidence: provider confidence 0.12 below the legibility floor. Read the highlighted region on the image.", (6, "Fever"): ""}
    assert [found[1, "TB"][c] for c in ("x", "y", "width", "height", "handwritten")] == [40.0, 10.0, 200.0, 70.0, True] and not found[6, "Fever"]["handwritten"]


def test_framed_regions_are_stamps(spark):
    x = np.full((200, 300), 230, np.uint8)
    for top, left, h, w in ((20, 20, 60, 100), (120, 20, 25, 100)):
        x[top:top + h, left:left + w] = 40
        x[top + 2:top + h - 2, left + 2:left + w - 2] = 230
    words = spark.createDataFrame([(p, g, left, top, w, h, 1, 0.9, "seal of office") for p in (1, 2, 3) for g, (left, top, w, h) in enumerate([(20, 20, 100, 60), (20, 120, 100, 25), (150, 20, 100, 60), (280, 150, 100, 100), (400, 10, 60, 60)])],
                                  "page_id long, group_no int, x int, y int, w int, h int, order_no int, confidence double, text string")
    images = spark.createDataFrame([(1, measure.write_pgm(x)), (2, b"no image")], "page_id long, content binary")
    got = {(r["page_id"], r["group_no"]): (r["category"], r["category_confidence"]) for r in extract.assembled_regions(words, ["page_id"], images).collect()}
    assert got == {(p, g): (("stamp", 0.58) if (p, g) == (1, 0) else ("note", 0.75)) for p in (1, 2, 3) for g in range(5)}
    assert extract.assembled_regions(words.limit(0), ["page_id"], images).count() == 0


def test_private_columns_of_an_export(spark):
    view = spark.createDataFrame([(1, 7, 102, "k", 10, 20), (2, 7, 201, None, None, None)], "page_id long, document_id long, version_id long, storage_key string, width long, height long")
    findings = spark.createDataFrame([(1, "NOISE", "low", 0.5), (1, "BLUR", "high", None), (1, "X", "low", None)], "page_id long, code string, severity string, confidence double")
    regions = spark.createDataFrame([(1, "note"), (1, "note")], "page_id long, category string")
    extractions = spark.createDataFrame([(1, "uncertain", "Impression")], "page_id long, diagnosis_status string, anchor_label string")
    rows = {r["page_id"]: r for r in exports.with_private(view.select("page_id"), view, findings, regions, extractions).collect()}
    assert [(f["defect_code"], f["label"], f["confidence"]) for f in rows[1]["_quality_findings"]] == [("BLUR", "Blurred / out of focus", None), ("NOISE", "Noisy / speckled", 0.5), ("X", "X", None)]
    assert [f["category"] for f in rows[1]["_handwriting_regions"]] == ["note", "note"] and rows[1]["_diagnosis_regions"][0]["anchor_label"] == "Impression"
    assert (rows[2]["_page_version_id"], rows[2]["_quality_findings"], rows[2]["_handwriting_regions"], rows[2]["_diagnosis_regions"]) == (201, [], [], [])
    assert exports.public(exports.with_private(view.select("page_id"), view, findings, regions, extractions)).columns == ["page_id"]


def test_lines_are_asked_whether_they_stop_behind_labels_alone(spark):
    lines = spark.createDataFrame([(1, "Diagnosis:", 0.0, 0.0, 30.0, 0.9), (1, "fever", 0.0, 40.0, 30.0, 0.9), (1, "Date: 1", 0.0, 80.0, 30.0, 0.9), (1, "Impression: cough", 0.0, 120.0, 30.0, 0.9)],
                                  "page_id int, text string, x double, y double, height double, confidence double")
    found = extract.labelled_values(lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["label"], r["value"]) for r in found.collect()) == [("Diagnosis", "fever"), ("Impression", "cough")]
    below = plan[plan.index("Window"):]  # what comes before the window, on every line
    assert "investigations?" in plan and "investigations?" not in below
    for pattern, _ in extract.LABELS:  # each label is let through by the hint
        word = next(w for w in ("diagnos", "deagnosis", "impression") if w in pattern)
        assert word in extract.LABEL_HINT


def test_pages_that_are_dealt_stay_where_they_are_and_images_are_not_dealt(spark):
    def read(name):
        if name == "broken":
            raise ValueError("no image")
        x = np.full((120, 120), 240, np.uint8)
        if name == "framed":
            x[10:60, 10:80][[0, 1, -2, -1]] = 60
        return x

    lines = spark.createDataFrame([(p, g, 10, 10, w, 50, g, "x") for p in (1, 2, 3, 4, 5, None) for g, w in ((0, 70), (1, 20))], "page_id long, group_no int, x int, y int, w int, h int, order_no int, text string").withColumn("text", F.lit("two"))
    words = lines.repartition(4, "page_id").withColumn("confidence", F.lit(None).cast("double"))
    images = lines.repartition(4, "page_id").filter("page_id < 5").groupBy("page_id").agg(F.max(F.expr("CASE page_id WHEN 1 THEN 'framed' WHEN 2 THEN 'plain' WHEN 3 THEN 'broken' END")).alias("content"))
    found = extract.assembled_regions(words, ["page_id"], images, read=read)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Join") == 1
    assert {(r["page_id"], r["group_no"]): r["category"] == "stamp" for r in found.collect()} == {(p, g): (p, g) == (1, 0) for p in (1, 2, 3, 4, 5, None) for g in (0, 1)}
    flags = measure.with_frames(lines.select("page_id", "group_no", *"xywh"), images, read)
    assert {(r["page_id"], r["group_no"]): r["framed"] for r in flags.collect()} == {(p, g): {1: True, 2: False}.get(p) if g == 0 else None for p in (1, 2, 3, 4, 5, None) for g in (0, 1)}
