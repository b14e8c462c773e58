"""Hot keys, numbering, leaders, settings in force; stages of a stream; folders of scans."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import checks, keyed, measure
from foliospark.sources import exports, scans
from foliospark.streaming import stages


def test_attach_keeps_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else (None if i % 4 else f"k{i % 8}"), i % 3) for i in range(100)], "i int, k string, j int")
    groups = rows.groupBy("k", "j").agg(F.count("*").alias("n"), F.min("i").alias("v"))
    found = {r["i"]: r["v"] for r in keyed.attach(rows, groups, ["k", "j"], "n", 100).collect()}
    firsts = {}
    for i in range(100):
        firsts.setdefault(("hot" if i % 2 else f"k{i % 8}", i % 3), i)
    assert found == {i: None if not i % 2 and i % 4 else firsts["hot" if i % 2 else f"k{i % 8}", i % 3] for i in range(100)}


@pytest.mark.parametrize("hot", [10, 1000])
def test_numbers_within_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(keyed, "HOT", hot)
    draw = random.Random(1)
    rows = [(i, draw.choice(["hot", "hot", "hot", "a", "b", None, f"k{i}"]), draw.randint(0, 9)) for i in range(400)]
    table = spark.createDataFrame(rows, "i int, k string, o int").repartition(7)
    found = {r["i"]: r["row_no"] for r in keyed.numbered(table, ["k"], ["o", "i"]).collect()}
    wanted, seen = {}, {}
    for i, k, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        wanted[i] = seen[k] = seen.get(k, 0) + 1
    assert found == wanted
    assert keyed.numbered(table.limit(0), ["k"], ["o"]).count() == 0
    same = spark.createDataFrame([("x", 1)] * 50, "k string, o int")
    assert sorted(r["row_no"] for r in keyed.numbered(same, ["k"], ["o"]).collect()) == list(range(1, 51))


def test_archive_names_of_a_hot_name(spark):
    pages = spark.createDataFrame([(i, "b", "f" if i % 3 else f"g{i}", 1, 1) for i in range(60)], "page_id long, batch string, filename string, ordinal int, versions int")
    names = [r["name"] for r in exports.archive_names(pages).orderBy("page_id").collect()]
    assert len(set(names)) == 60 and names[1] == "b/f/p0001_v1.png" and names[2] == "b/f/p0001_v1__2.png" and names[59] == "b/f/p0001_v1__40.png"


def walk(rows, most=6):
    out, kept = {}, {}
    for case, _, page, h in sorted(rows, key=lambda r: (r[1], r[2])):
        near = next((p for p, g in kept.setdefault(case, []) if (g ^ h).bit_count() <= most), None) if h is not None and case is not None else None
        out[page] = near
        if near is None and h is not None and case is not None:
            kept[case].append((page, h))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_the_walk_in_scan_order(spark, seed):
    draw = random.Random(seed)
    centres = [draw.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(400):
        h = draw.choice(centres)
        for _ in range(draw.choice([0, 0, 2, 3, 4, 6])):
            h ^= 1 << draw.randrange(63)
        rows.append((draw.choice([1, 1, 1, 2, 3]), draw.randint(0, 300), i, h))  # one case holds most pages
    chain, h = [], 0
    for i in range(12):  # each page is near the one before only
        chain.append((9, i, 1000 + i, h))
        h ^= sum(1 << (5 * i + j) for j in range(5))
    rows += chain + [(1, 5, 2000, None), (None, 5, 2001, 7), (None, 6, 2002, 7)]
    table = spark.createDataFrame(rows, "case_id long, ordinal int, page_id long, hash long").repartition(5)
    assert {r["page_id"]: r["duplicate_of"] for r in checks.leaders(table).collect()} == walk(rows)
    assert checks.leaders(table.limit(0)).count() == 0


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_near_pairs_of_planted_hashes(spark, agree):
    draw = random.Random(agree)
    hashes = [(i, draw.getrandbits(63)) for i in range(150)]
    hashes += [(1000 + i, h ^ sum(1 << b for b in draw.sample(range(63), draw.randint(0, 8)))) for i, h in hashes]
    found = {(r["a"], r["b"], r["distance"]) for r in checks.near_pairs(spark.createDataFrame([*hashes, (5000, None)], "id long, hash long"), agree=agree).collect()}
    wanted = {(i, j, (g ^ h).bit_count()) for i, g in hashes for j, h in hashes if i < j and (g ^ h).bit_count() <= 6}
    assert found == wanted and len(found) > 80


def test_copies_of_a_hot_content(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT", 10)
    rows = [(i, "g" if i % 5 else None, "same" if i % 2 else f"t{i}") for i in range(100)] + [(200, "g", None), (201, "g", None), (202, "g", "t2")]
    found = {r["i"] for r in checks.exact_duplicates(spark.createDataFrame(rows, "i int, g string, t string"), "g", F.col("t"), ["i"]).collect()}
    assert found == {i for i in range(2, 100) if i % 2 and i % 5} | {202}
    plan = checks.exact_duplicates(spark.createDataFrame(rows, "i int, g string, t string"), "g", F.col("t"), ["i"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_settings_in_force(spark):
    draw, start = random.Random(3), datetime(2024, 1, 1)
    defaults = {"skew_deg": 1.5, "noise_sigma": 2.0, "dark": 90.0}
    changes = [(start + timedelta(hours=draw.randint(0, 400)), i, draw.choice(["skew_deg", "noise_sigma", "other"]), draw.choice([None, draw.random(), draw.random()])) for i in range(60)] + [(None, 99, "dark", 1.0)]
    pages = [(i, start + timedelta(minutes=draw.randint(-3000, 30_000))) for i in range(300)] + [(900 + i, c[0]) for i, c in enumerate(changes)] + [(990, None)]
    log = spark.createDataFrame(changes, "changed_at timestamp, change_id int, threshold string, value double")
    table = spark.createDataFrame(pages, "page_id int, at timestamp")
    found = {r["page_id"]: r["thresholds"] for r in keyed.in_force(table, "at", log, defaults).collect()}

    def plain(at):
        now = dict(defaults)
        for t, _, name, v in sorted((c for c in changes if c[0]), key=lambda c: c[:2]):
            if at and t <= at and name in now and v is not None:
                now[name] = v
        return now

    assert found == {i: plain(at) for i, at in pages}
    assert all(r["thresholds"] == defaults for r in keyed.in_force(table, "at", log.limit(0), defaults).collect())


# ---- stages of a stream ---------------------------------------------------------------------------------------------------------------


def test_stages_survive_a_crash_between_outputs(spark, tmp_path):
    source, path, killed = str(tmp_path / "in"), str(tmp_path / "out"), []
    schema = "page_id long, v long"

    def kill_once(batch):
        if not killed:
            killed.append(1)
            raise stages.StopStream("lost")
        return batch.select("page_id", (F.col("v") * 2).alias("twice"))

    work = {"quality": lambda b: b.select("page_id", F.col("v").alias("score")), "handwriting": kill_once, "diagnosis": lambda b: b.groupBy((F.col("v") % 2).alias("odd")).count()}
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for i in range(3):
        spark.range(100 * i, 100 * i + 100).select(F.col("id").alias("page_id"), F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception):  # noqa: B017
        stages.run_stages(stream(), work, path).awaitTermination()
    assert killed and stages.output(spark, path, "quality").count() == 100  # the first output is there, the second isn't
    query = stages.run_stages(stream(), work, path)
    query.awaitTermination()
    assert query.exception() is None
    for name, column in (("quality", "score"), ("handwriting", "twice")):
        rows = stages.output(spark, path, name)
        assert sorted(r["page_id"] for r in rows.collect()) == list(range(300)) and rows.select("batch").distinct().count() == 3 and column in rows.columns
    assert stages.output(spark, path, "diagnosis").agg(F.sum("count")).first()[0] == 300 and stages.output(spark, path, "failures").count() == 0


def test_a_failing_stage_leaves_the_others_alone(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)

    def broken(batch):
        raise ValueError("no such model")

    work = {"first": broken, "second": lambda b: b}
    stages.run_stages(spark.readStream.schema("id long").parquet(source), work, path).awaitTermination()
    assert stages.output(spark, path, "second").count() == 10
    (failure,) = stages.output(spark, path, "failures").collect()
    assert (failure["stage"], failure["error"], failure["n_rows"]) == ("first", "ValueError: no such model", 10)
    stages.repeat(spark, spark.read.parquet(source), {"first": lambda b: b}, path, "first", 0)
    assert stages.output(spark, path, "first").count() == 10 and stages.output(spark, path, "failures").count() == 0
    with pytest.raises(ValueError):
        stages.run_stages(spark.readStream.schema("id long").parquet(source), {"failures": broken}, path)


def test_a_log_is_appended_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).write.mode("append").parquet(source)
        stages.append_log(spark.readStream.schema("id long").parquet(source), path).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(30))


# ---- scans ----------------------------------------------------------------------------------------------------------------------------


def test_a_folder_of_scans(spark, tmp_path):
    from test_kernels import text_page

    folder = tmp_path / "scans"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.pgm").write_bytes(measure.write_pgm(text_page(500, 400)))
    (folder / "deep" / "b.PGM").write_bytes(b"broken")
    (folder / "deep" / "c.pgm").write_bytes(b"")
    (folder / "note.txt").write_bytes(b"x")
    found = scans.read_scans(spark, str(folder), partbytes="10")
    assert found.rdd.getNumPartitions() == 2  # two small ones together
    assert [(r["page_id"], r["filename"]) for r in found.orderBy("page_id").collect()] == [(0, "a.pgm"), (1, "b.PGM"), (2, "c.pgm")]
    report = scans.calibration(found)
    rows = {r["filename"]: r for r in report.collect()}
    assert len(rows) == 3 and rows["a.pgm"]["error"] is None and rows["a.pgm"]["class"] != "failed" and all(rows[n]["class"] == "failed" and rows[n]["error"] for n in ("b.PGM", "c.pgm"))
    n = {(r["kind"], r["name"]): (r["n"], r["seconds"]) for r in scans.counters(report).collect()}
    assert n["pages", "all"][0] == 3 and n["pages", "all"][1] > 0 and n["error", "unreadable"][0] == 2 and n["class", "failed"] == (2, None)
    for form in ("csv", "json"):
        scans.write_report(report, str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == report.columns
    with pytest.raises(ValueError):
        scans.write_report(report, str(tmp_path / "x"), "xml")


def test_written_scans_come_back(spark, tmp_path):
    images = spark.createDataFrame([(f"{i:03}.pgm", bytes([i]) * i) for i in range(20)] + [("none.pgm", None)], "filename string, content binary").repartition(4)
    sizes = scans.write_scans(images, str(tmp_path / "w")).agg(F.sum("bytes"), F.count("*")).first()
    assert tuple(sizes) == (190, 21)
    assert {r["filename"]: bytes(r["content"]) for r in scans.read_scans(spark, str(tmp_path / "w")).collect()} == {f"{i:03}.pgm": bytes([i]) * i for i in range(20)} | {"none.pgm": b""}


def test_packed_scans_are_small_and_many_tasks(spark, tmp_path):
    page = measure.write_pgm(np.full((300, 200), 244, np.uint8))
    images = spark.createDataFrame([(i, f"{i:03d}.pgm.gz", page if i % 10 else b"broken") for i in range(70)], "page_id long, filename string, content binary")
    scans.write_scans(images, str(tmp_path / "s")).count()
    assert sum(f.stat().st_size for f in (tmp_path / "s").glob("*.gz")) < 70 * len(page) / 50  # the pixels themselves would be 60 KB each
    read = scans.read_scans(spark, str(tmp_path / "s"))
    assert read.rdd.getNumPartitions() == 3 and read.filter(F.col("content") == F.lit(bytearray(page))).count() == 63
    report = scans.calibration(read)
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()  # each scan is read once
    assert {(r["kind"], r["n"]) for r in scans.counters(report).filter("kind IN ('pages', 'error')").collect()} == {("pages", 70), ("error", 7)}


def test_settings_of_one_busy_moment(spark):
    """Many changes of a day don't meet each of its rows: no row holds a list of them."""
    log = spark.range(2000).select(F.timestamp_seconds(F.col("id") / 4).alias("changed_at"), F.col("id").alias("change_id"), F.lit("dark").alias("threshold"), F.col("id").cast("double").alias("value"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.timestamp_seconds(F.lit(100)).alias("at"))
    found = keyed.in_force(pages, "at", log, {"dark": 1.0, "light": 2.0})
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert found.columns == ["page_id", "at", "thresholds"] and found.count() == 2000
    assert found.filter(F.col("thresholds")["dark"] == 400.0).filter(F.col("thresholds")["light"] == 2.0).count() == 2000


def test_rounds_of_leaders_broadcast_nothing(spark, monkeypatch):
    plans, kept = [], keyed.written
    monkeypatch.setattr(keyed, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    table = spark.createDataFrame([(1, i, i, (1 << (i % 7)) - 1) for i in range(60)], "case_id long, ordinal int, page_id long, hash long")
    assert checks.leaders(table).count() == 60
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)
