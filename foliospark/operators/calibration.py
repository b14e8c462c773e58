"""Threshold tuning from what reviewers call no defect: one bounded step at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may be tuned (code, metric, threshold, which side is bad) and floor, ceiling and largest step of each threshold.
TUNABLE = (
    ("BLUR", "stroke_sharpness", "sharpness_min", "lower_bad"), ("FAINT", "ink_paper_contrast", "faint_ink_paper_contrast", "lower_bad"), ("LOW_CONTRAST", "ink_paper_contrast", "low_contrast_ink_paper", "lower_bad"),
    ("DARK", "median_luma", "dark_median_luma", "lower_bad"), ("NOISE", "noise_sigma", "noise_sigma", "higher_bad"), ("SKEWED", "skew_deg", "skew_deg", "higher_bad"), ("GLARE", "glare_area_fraction", "glare_area_fraction", "higher_bad"),
    ("SHADOW", "shadow_area_fraction", "shadow_area_fraction", "higher_bad"), ("SHADOW", "illumination_ratio", "illumination_ratio", "higher_bad"))
BOUNDS = {
    "sharpness_min": (1.0, 3.5, 0.20), "faint_ink_paper_contrast": (20.0, 60.0, 0.20), "low_contrast_ink_paper": (40.0, 90.0, 0.20), "dark_median_luma": (60.0, 150.0, 0.20), "noise_sigma": (1.5, 8.0, 0.25),
    "skew_deg": (0.5, 6.0, 0.25), "glare_area_fraction": (0.005, 0.10, 0.30), "shadow_area_fraction": (0.05, 0.30, 0.30), "illumination_ratio": (1.5, 4.0, 0.20)}
LEAST_SAMPLES, NEWEST = 5, 500


def false_positives(reviews: DataFrame, code: Column, newest: int = NEWEST) -> DataFrame:
    """Of the newest corrections (all codes) those that call this code no defect. A page corrected twice counts twice."""
    last = reviews.filter("action = 'correct_finding'").orderBy(F.desc("created_at"), F.desc("review_id")).limit(newest)
    return last.filter(F.get_json_object("payload", "$.defect_code").eqNullSafe(code) & (F.get_json_object("payload", "$.verdict") == "not_a_defect"))


def next_value(values: DataFrame, value: str, current: float, bounds: tuple[float, float, float], direction: str) -> DataFrame:
    """One row: how many values lie beyond the threshold, and its next value (null: too few)."""
    floor, ceiling, step = bounds
    x = F.col(value)
    beyond = x > current if direction == "higher_bad" else x < current
    rows = values.filter(x.isNotNull() & beyond).agg(F.array_sort(F.collect_list(x)).alias("v"))  # at most NEWEST values
    share, stretch = (0.8, 1.05) if direction == "higher_bad" else (0.2, 0.95)
    n = F.size("v")
    target = F.get("v", (n * share).cast("int")) * stretch
    stepped = (F.least(F.least(target, F.lit(current * (1 + step))), F.lit(ceiling)) if direction == "higher_bad"
               else F.greatest(F.greatest(target, F.lit(current * (1 - step))), F.lit(floor)))
    return rows.select(n.alias("samples"), F.when(n >= LEAST_SAMPLES, F.bround(stepped, 4)).alias("threshold"))


def tuning_steps(reviews: DataFrame, metrics: DataFrame, thresholds: dict) -> DataFrame:
    """All changes that the newest corrections call for: defect_code, threshold, from, to, sample_size; thresholds that stay have no row.

    ``metrics`` has page_id and the measured columns of ``TUNABLE``; ``reviews`` has page_id, action, created_at, review_id and payload. One plan for
    all thresholds: at most ``NEWEST`` corrections meet their pages' metrics, and each is unfolded into the thresholds of its code.
    """
    last = reviews.filter("action = 'correct_finding'").orderBy(F.desc("created_at"), F.desc("review_id")).limit(NEWEST)
    wrong = last.filter(F.get_json_object("payload", "$.verdict") == "not_a_defect").select("page_id", F.get_json_object("payload", "$.defect_code").alias("_code"))
    measured = metrics.select("page_id", *{m for _, m, _, _ in TUNABLE})
    used = [t for t in TUNABLE if thresholds.get(t[2]) is not None]
    if not used:
        return wrong.sparkSession.createDataFrame([], "defect_code string, threshold string, `from` double, `to` double, sample_size int")

    def row(code: str, metric: str, name: str, side: str) -> Column:
        floor, ceiling, step = BOUNDS[name]
        value = F.abs(metric) if metric == "skew_deg" else F.col(metric)
        return F.struct(F.lit(code).alias("defect_code"), F.lit(name).alias("threshold"), F.lit(float(thresholds[name])).alias("from"), value.cast("double").alias("v"), F.lit(side == "higher_bad").alias("up"),
                        F.lit(floor).alias("floor"), F.lit(ceiling).alias("ceiling"), F.lit(step).alias("step"))

    rows = F.filter(F.array(*[row(*t) for t in used]), lambda r: (r["defect_code"] == F.col("_code")) & F.when(r["up"], r["v"] > r["from"]).otherwise(r["v"] < r["from"]))
    beyond = wrong.join(measured, "page_id").select(F.inline(rows))
    taken = beyond.groupBy("defect_code", "threshold", "from", "up", "floor", "ceiling", "step").agg(F.array_sort(F.collect_list("v")).alias("v")).filter(F.size("v") >= LEAST_SAMPLES)
    n, now = F.size("v"), F.col("from")
    target = F.get("v", F.floor(n * F.when(F.col("up"), 0.8).otherwise(0.2)).cast("int")) * F.when(F.col("up"), 1.05).otherwise(0.95)
    stepped = F.when(F.col("up"), F.least(target, now * (1 + F.col("step")), F.col("ceiling"))).otherwise(F.greatest(target, now * (1 - F.col("step")), F.col("floor")))
    return taken.select("defect_code", "threshold", "from", F.bround(stepped, 4).alias("to"), n.alias("sample_size")).filter(F.abs(F.col("to") - now) >= 1e-9)


def audit_row(steps: DataFrame) -> DataFrame:
    """The log entry of a tuning run, one row with the changes as a map; no row where nothing changes."""
    changes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("threshold", "to"))))
    return steps.agg(F.count("*").alias("_n"), changes.alias("changes")).filter("_n > 0").select(F.lit("settings.thresholds.autotune").alias("action"), F.lit("settings").alias("entity_type"), "changes")
