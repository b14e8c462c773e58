"""Queries on drawn scans, on stages of a stream, and on the history of settings."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import keyed, measure, rules
from foliospark.queries import query
from foliospark.sources import scans
from foliospark.streaming import stages


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of a letter's ink, a bar and a foot, as (row, column), by the letter's number modulo 12.
_LETTERS = [np.array([(row, column) for row in range(13) for column in range(7) if row >= 4 - n % 4 and column < 2 or row >= 11 and column < 5 + n % 3]).T for n in range(12)]


def _drawn(page: int, text: str | None) -> bytes:
    """A sheet with a bar for each letter of the text, as far as it goes; every seventh one lies in a shadow, every eighth is turned, every fifth lies on a dark desk."""
    wide, left, top, begins, words = 628, 45, 50, [], []
    for word in (text or "").split():
        if left + 9 * len(word) > 575:
            left, top = 45, top + 20
        if top > 810:
            break
        begins.append(top * wide + left)
        words.append(word[:64])  # the next ones lie beyond the sheet
        left += 9 * len(word) + 8
    sizes = np.array([len(w) for w in words], int)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) % 12
    at = np.repeat(np.array(begins, int) - 9 * (np.cumsum(sizes) - sizes), sizes) + 9 * np.arange(len(letters))
    seen = at % wide < 620
    x = np.full((877, wide), 244, np.uint8)
    for n, (down, across) in enumerate(_LETTERS):
        x.ravel()[at[seen & (letters == n)][:, None] + down * wide + across] = 40
    x = np.ascontiguousarray(x[:, :620])
    if page % 7 == 3:
        x[:300, :250] = x[:300, :250] * 0.55
    if page % 8 == 1:
        x = np.rot90(x)
    if page % 5 == 2:
        x = np.pad(x, 40, constant_values=18)
    return measure.write_pgm(x)


def drawn_pages(spark, sf_dir):
    """An image of the text of every page: page_id, filename and content."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    draw = F.udf(_drawn, "binary", useArrow=False)  # makes test images
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # a page is little data and much work, so that Spark's own count would be too small
    return _t(spark, sf_dir, "pages").repartition(tasks, "page_id").select("page_id", F.format_string("%012d.pgm", "page_id").alias("filename"), draw("page_id", plain).alias("content"))


@query("SELECT page_id, page_id % 5 = 2 AS on_desk, CASE WHEN page_id % 5 = 2 THEN 'top,bottom,left,right' ELSE '' END AS visible_edges FROM pages")
def drawn_page_sheets(spark, sf_dir):
    """Which drawn pages lie on a dark desk, and the sides on which that is seen, as the measurement of the image finds it."""
    found = measure.measured(drawn_pages(spark, sf_dir), ("doc_area_fraction", "visible_edges"))
    return found.select("page_id", (F.col("doc_area_fraction") < 0.95).alias("on_desk"), F.array_join("visible_edges", ",").alias("visible_edges"))


@query()
def drawn_page_metrics(spark, sf_dir):
    """Every page drawn, measured and judged."""
    return rules.judge(measure.measured(drawn_pages(spark, sf_dir))).drop("seconds", "thresholds_hash")


@query()
def problem_regions(spark, sf_dir):
    return measure.problem_regions(measure.measured(drawn_pages(spark, sf_dir), measure.REGIONS))


@query("SELECT 'pages' AS kind, 'all' AS name, count(*) AS n FROM pages UNION ALL SELECT 'error', 'unreadable', count(*) FROM pages WHERE page_id % 11 = 3 HAVING count(*) > 0")
def scan_calibration(spark, sf_dir):
    """Every page drawn into a folder of scans, every eleventh one broken, read by the data source, measured and counted."""
    content = F.when(F.col("page_id") % 11 == 3, F.lit("broken").cast("binary")).otherwise(F.col("content"))
    folder = f"{keyed.shared_folder(spark)}/scans-{uuid.uuid4().hex[:12]}"
    named = drawn_pages(spark, sf_dir).withColumns({"content": content, "filename": F.concat("filename", F.lit(".gz"))})
    scans.write_scans(named, folder).write.format("noop").mode("overwrite").save()
    report = keyed.written(scans.calibration(scans.read_scans(spark, folder)), "report")
    return scans.counters(report).filter(F.col("kind").isin("pages", "error")).select("kind", "name", "n")


@query("""SELECT 'types' AS stage, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'users', CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'failures', 'broken', CAST(count(*) AS BIGINT) FROM events HAVING count(*) > 0""")
def stage_outputs(spark, sf_dir):
    """All events as a stream through three stages, of which one always fails; what the outputs hold in all."""

    def broken(batch):
        raise ValueError("no model")

    work = {"types": lambda b: b.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")), "broken": broken,
            "users": lambda b: b.groupBy(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("name")).agg(F.count("*").alias("n"))}
    path = f"{keyed.shared_folder(spark)}/stages-{uuid.uuid4().hex[:12]}"
    events = _t(spark, sf_dir, "events")
    stages.run_stages(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]"), work, path).awaitTermination()
    parts = [stages.output(spark, path, name).select(F.lit(name).alias("stage"), "name", "n") for name in ("types", "users")]
    failures = stages.output(spark, path, stages.FAILURES).select(F.lit("failures").alias("stage"), F.col("stage").alias("name"), F.col("n_rows").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(failures).groupBy("stage", "name").agg(F.sum("n").alias("n"))


@query("""WITH c AS (SELECT ts, event_id, CASE event_id % 3 WHEN 0 THEN 'skew_deg' WHEN 1 THEN 'noise_sigma' ELSE 'other' END AS threshold, value FROM events WHERE event_type = 'click'),
f AS (SELECT ts, threshold, max_by(value, event_id) AS value FROM c WHERE value IS NOT NULL GROUP BY 1, 2),
s AS (SELECT * FROM f WHERE threshold = 'skew_deg'), n AS (SELECT * FROM f WHERE threshold = 'noise_sigma'),
p AS (SELECT event_id AS page_id, ts AS measured_at FROM events WHERE event_type <> 'click')
SELECT page_id, coalesce(s.value, 1.5) AS skew_deg, coalesce(n.value, 3.2) AS noise_sigma FROM p ASOF LEFT JOIN s ON p.measured_at >= s.ts ASOF LEFT JOIN n ON p.measured_at >= n.ts""")
def settings_in_force(spark, sf_dir):
    """Thresholds as they were when each page was measured: clicks are changes, other events are pages."""
    e = _t(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, "skew_deg").when(F.col("event_id") % 3 == 1, "noise_sigma").otherwise("other")
    changes = e.filter("event_type = 'click'").select(F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"), name.alias("threshold"), "value")
    pages = e.filter("event_type <> 'click'").select(F.col("event_id").alias("page_id"), F.col("ts").alias("measured_at"))
    found = keyed.in_force(pages, "measured_at", changes, {"skew_deg": 1.5, "noise_sigma": 3.2})
    return found.select("page_id", F.col("thresholds")["skew_deg"].alias("skew_deg"), F.col("thresholds")["noise_sigma"].alias("noise_sigma"))


@query("""WITH h AS (SELECT p_brand AS k, p_partkey AS id FROM part) SELECT id, k || '__' || row_number() OVER (PARTITION BY k ORDER BY id) AS name FROM h""")
def numbered_names(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("id"))
    return keyed.numbered(rows, ["k"], ["id"]).select("id", F.concat("k", F.lit("__"), "row_no").alias("name"))
