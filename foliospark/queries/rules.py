"""Queries on the threshold rules and their tuning; metrics are derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import calibration, rules
from foliospark.queries import query

#: name: (SQL, same expression of the order line's columns)
_METRICS = {
    "width": "1240", "height": "CASE WHEN l_quantity = 50 THEN 0 ELSE 1754 END", "error": "CASE WHEN l_quantity = 49 THEN 'unreadable' END", "is_bitonal": "l_returnflag = 'R'",
    "text_ink_coverage": "l_discount * 0.5", "ink_coverage": "l_discount", "text_component_count": "CAST(l_quantity AS INTEGER) * 4", "stroke_sharpness": "l_tax * 50", "ink_paper_contrast": "l_quantity * 2",
    "median_luma": "70 + l_linenumber * 20.0", "noise_sigma": "l_discount * 80", "snr": "l_quantity", "rotation_deg": "CASE WHEN l_linenumber = 3 THEN 90 ELSE 0 END", "rotation_confidence": "l_tax * 10",
    "skew_deg": "l_quantity / 10 - 2", "glare_area_fraction": "l_tax", "shadow_area_fraction": "l_discount * 1.5", "illumination_ratio": "1.0 + l_tax * 10", "tile_count": "CAST(l_linenumber AS INTEGER) * 2",
    "low_contrast_tiles": "CAST(l_linenumber AS INTEGER)", "est_text_height_px": "l_quantity / 2", "edges": "CAST(l_linenumber AS INTEGER) % 3"}


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = F.slice(F.array(F.lit("left"), F.lit("top")), 1, F.col("edges"))
    return lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"{sql} AS {name}" for name, sql in _METRICS.items()]).withColumn("cutoff_edges", edges)


def _when(code: str, *cases: tuple[str, str]) -> str:
    """SQL of one rule: an array of the codes's finding, or an empty one."""
    return "CASE " + " ".join(f"WHEN {c} THEN [{{'code': '{code if ':' not in s else s.split(':')[1]}', 'severity': '{s.split(':')[0]}'}}]" for c, s in cases) + " ELSE [] END"


_RULES = " || ".join([
    _when("NEAR_BLANK", ("text_ink_coverage < 0.015", "low")), _when("BITONAL_LOSS", ("is_bitonal", "medium")),
    _when("BLUR", ("NOT is_bitonal AND ink_coverage >= 0.005 AND stroke_sharpness > 0 AND stroke_sharpness < 1.2", "high"), ("NOT is_bitonal AND ink_coverage >= 0.005 AND stroke_sharpness > 0 AND stroke_sharpness < 2", "medium")),
    _when("FAINT", ("text_ink_coverage >= 0.015 AND ink_paper_contrast < 28", "high"), ("text_ink_coverage >= 0.015 AND ink_paper_contrast < 45", "medium"), ("text_ink_coverage >= 0.015 AND ink_paper_contrast < 70", "medium:LOW_CONTRAST")),
    _when("DARK", ("median_luma < 85", "high"), ("median_luma < 120", "medium")),
    _when("NOISE", ("NOT is_bitonal AND noise_sigma > 6", "high"), ("NOT is_bitonal AND noise_sigma > 3 AND snr < 12", "medium")),
    _when("ROTATED", ("text_component_count >= 120 AND rotation_deg IN (90, 270) AND rotation_confidence >= 0.55", "high"), ("text_component_count >= 120 AND rotation_deg IN (90, 270) AND rotation_confidence >= 0.3", "medium")),
    _when("SKEWED", ("text_component_count >= 120 AND abs(skew_deg) >= 3.5", "high"), ("text_component_count >= 120 AND abs(skew_deg) >= 1.5", "low")),
    _when("GLARE", ("glare_area_fraction > 0.07", "high"), ("glare_area_fraction > 0.015", "medium")), _when("SHADOW", ("shadow_area_fraction > 0.1 OR illumination_ratio > 2.2", "medium")),
    _when("UNREADABLE_REGION", ("tile_count >= 4 AND low_contrast_tiles / tile_count > 0.45", "high"), ("tile_count >= 4 AND low_contrast_tiles / tile_count > 0.2", "medium")),
    _when("LOW_RESOLUTION", ("est_text_height_px > 0 AND est_text_height_px < 9", "medium")), _when("SUSPECTED_CUTOFF", ("edges >= 2", "high"), ("edges = 1", "medium"))])
_JUDGED = f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f'{v} AS {k}' for k, v in _METRICS.items())} FROM lineitem),
s AS (SELECT *, CASE WHEN error IS NOT NULL OR width = 0 OR height = 0 THEN 'failed' WHEN median_luma < 85 AND text_ink_coverage < 0.004 THEN 'dark' WHEN text_ink_coverage < 0.004 AND text_component_count < 40 THEN 'blank' ELSE 'rules' END AS kind FROM m),
f AS (SELECT *, CASE kind WHEN 'dark' THEN [{{'code': 'DARK', 'severity': 'high'}}] WHEN 'rules' THEN {_RULES} ELSE [] END AS findings FROM s),
p AS (SELECT *, coalesce(list_sum(list_transform(findings, lambda x: CASE x.severity WHEN 'high' THEN 6.0 WHEN 'medium' THEN 2.5 ELSE 1.0 END)), 0) AS penalty,
  len(list_filter(findings, lambda x: x.severity = 'high' AND x.code IN ('BLUR', 'FAINT', 'DARK', 'UNREADABLE_REGION', 'ROTATED'))) > 0 AS forced FROM f)
"""


@query(_JUDGED + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform(findings, lambda x: x.code || ':' || x.severity), ',') AS findings FROM p")
def rule_engine_findings(spark, sf_dir):
    text = F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit(":"), f["severity"])), ",")
    return rules.judge(metrics(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("findings"))


_LABELLED = "CASE x.code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.LABELS.items()) + " END || ' (' || x.severity || ')'"


@query(_JUDGED + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(array_to_string(list_transform(findings, lambda x: {_LABELLED}), '; '), ''), 'no finding') AS reason FROM p")
def reason_text(spark, sf_dir):
    return rules.judge(metrics(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.reason(F.col("findings"), F.lit("no finding")).alias("reason"))


@query(_JUDGED + """SELECT CASE kind WHEN 'failed' THEN 'failed' WHEN 'dark' THEN 'rescan' WHEN 'blank' THEN 'blank' ELSE CASE WHEN forced OR penalty >= 6 THEN 'rescan' WHEN penalty >= 2.5 THEN 'review' ELSE 'acceptable' END END AS overall,
CASE kind WHEN 'failed' THEN 0.0 WHEN 'dark' THEN 0.0 WHEN 'blank' THEN 1.0 ELSE round(greatest(0.0, 1 - least(1.0, penalty / 12)), 3) END::DOUBLE AS score, count(*) AS pages FROM p GROUP BY ALL""")
def rule_engine_class(spark, sf_dir):
    return rules.judge(metrics(spark, sf_dir)).groupBy("overall", "score").agg(F.count("*").alias("pages"))


@query(_JUDGED + """, o AS (SELECT *, list_filter(findings, lambda x: x.code <> 'ROTATED') || CASE WHEN l_linenumber % 2 = 0 THEN [{'code': 'NOISE', 'severity': CASE WHEN l_tax_ >= 0.75 THEN 'high' WHEN l_tax_ >= 0.45 THEN 'medium' ELSE 'low' END}] ELSE [] END AS g
 FROM (SELECT *, rotation_confidence AS l_tax_ FROM p)),
q AS (SELECT *, coalesce(list_sum(list_transform(g, lambda x: CASE x.severity WHEN 'high' THEN 6.0 WHEN 'medium' THEN 2.5 ELSE 1.0 END)), 0) AS pen,
  len(list_filter(g, lambda x: x.severity = 'high' AND x.code IN ('BLUR', 'FAINT', 'DARK', 'UNREADABLE_REGION', 'ROTATED'))) > 0 AS force FROM o)
SELECT CASE WHEN force OR pen >= 6 THEN 'rescan' WHEN pen >= 2.5 THEN 'review' ELSE 'acceptable' END AS overall, count(*) AS pages FROM q GROUP BY 1""")
def provider_merge_reclassify(spark, sf_dir):
    judged = rules.judge(metrics(spark, sf_dir))
    defect = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("rotation_confidence").cast("double").alias("confidence"))
    theirs = F.when(F.col("l_linenumber") % 2 == 0, F.array(defect("quality/defect_noisy"), defect("quality/unknown")))
    return rules.with_provider(judged.withColumn("provider_defects", theirs), rotation_checked=True).groupBy("overall").agg(F.count("*").alias("pages"))


@query("""WITH last AS (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 500),
v AS (SELECT abs(value) AS x FROM last WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AND abs(value) > 1.5),
l AS (SELECT list(x ORDER BY x) AS v FROM v)
SELECT CAST(coalesce(len(v), 0) AS INTEGER) AS samples, CASE WHEN len(v) >= 5 THEN round_even(least(least(v[CAST(floor(len(v) * 0.8) AS INTEGER) + 1] * 1.05, 1.5 * 1.25), 6.0), 4) END AS threshold FROM l""")
def autotune_step(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    verdict = F.when(F.get_json_object("props", "$.k").cast("int") < 50, "not_a_defect").otherwise("defect")
    reviews = e.select(F.col("event_id").alias("review_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", "correct_finding").otherwise("comment").alias("action"), "value",
                       F.to_json(F.struct(F.lit("SKEWED").alias("defect_code"), verdict.alias("verdict"))).alias("payload"))
    values = calibration.false_positives(reviews, F.lit("SKEWED")).withColumn("value", F.abs("value"))
    return calibration.next_value(values, "value", rules.THRESHOLDS["skew_deg"], calibration.BOUNDS["skew_deg"], "higher_bad")


@query()
def image_metrics(spark, sf_dir):
    """Each embedding drawn as an 8 by 8 picture: measured, then judged."""
    from foliospark.operators import measure

    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 128 + 128))))
    pixels = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("page_id"), F.concat(F.lit("P5 8 8 255\n").cast("binary"), pixels).alias("content"))
    return rules.judge(measure.measured(images)).select("page_id", "median_luma", "hash", "overall", "score", "error")
