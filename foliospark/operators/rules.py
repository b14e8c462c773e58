"""The threshold rules: from measured metrics to findings, a score and a class, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes in report order, default thresholds and severity weights.
DEFECTS = ("BLUR", "FAINT", "DARK", "LOW_CONTRAST", "NOISE", "ROTATED", "SKEWED", "GLARE", "SHADOW", "UNREADABLE_REGION", "SUSPECTED_CUTOFF", "BITONAL_LOSS", "LOW_RESOLUTION", "NEAR_BLANK")
THRESHOLDS = {
    "blank_ink_coverage": 0.004, "blank_component_count": 40, "near_blank_ink_coverage": 0.015,
    "sharpness_min": 2.0, "sharpness_severe": 1.2, "sharpness_min_ink_coverage": 0.005,
    "faint_ink_paper_contrast": 45.0, "faint_severe_contrast": 28.0, "low_contrast_ink_paper": 70.0,
    "dark_median_luma": 120.0, "dark_severe_median_luma": 85.0, "noise_sigma": 3.0, "noise_sigma_severe": 6.0, "min_snr": 12.0,
    "skew_deg": 1.5, "skew_severe_deg": 3.5, "rotation_confident": 0.55, "rotation_uncertain": 0.30, "orientation_min_components": 120,
    "glare_area_fraction": 0.015, "glare_area_fraction_severe": 0.07, "shadow_area_fraction": 0.10, "illumination_ratio": 2.2,
    "unreadable_tile_fraction": 0.20, "min_text_height_px": 9.0, "rescan_severity_score": 6.0, "review_severity_score": 2.5,
}
LABELS = {
    "BLUR": "Blurred / out of focus", "FAINT": "Faint — ink barely separated from paper", "DARK": "Under-exposed / too dark", "LOW_CONTRAST": "Low overall contrast", "NOISE": "Noisy / speckled", "ROTATED": "Incorrectly rotated",
    "SKEWED": "Excessively skewed", "GLARE": "Glare / blown highlights", "SHADOW": "Shadow across the page", "UNREADABLE_REGION": "Region(s) likely unreadable", "SUSPECTED_CUTOFF": "Suspected cut-off page edge or text",
    "BITONAL_LOSS": "Saved as 1-bit — mid-tones lost", "LOW_RESOLUTION": "Text too small for reliable reading", "NEAR_BLANK": "Nearly blank"}
SEVERE_TILES = 0.45
WEIGHTS = {"low": 1.0, "medium": 2.5, "high": 6.0}
#: One high finding of these sends a page to be scanned again.
LEGIBILITY = ("BLUR", "FAINT", "DARK", "UNREADABLE_REGION", "ROTATED")
PROVIDER_CODES = {
    "quality/defect_blurry": "BLUR", "quality/defect_noisy": "NOISE", "quality/defect_dark": "DARK", "quality/defect_faint": "FAINT", "quality/defect_text_too_small": "LOW_RESOLUTION",
    "quality/defect_document_cutoff": "SUSPECTED_CUTOFF", "quality/defect_text_cutoff": "SUSPECTED_CUTOFF", "quality/defect_glare": "GLARE",
}
FINDING = "struct<code:string,severity:string,confidence:double,source:string>"


def merged(overrides: dict | None) -> dict:
    """Defaults with the known keys of ``overrides``."""
    return THRESHOLDS | {k: v for k, v in (overrides or {}).items() if k in THRESHOLDS}


def thresholds_hash(thresholds: dict) -> str:
    return hashlib.sha256(json.dumps(thresholds, sort_keys=True).encode()).hexdigest()[:16]


def _finding(code: str, severity: Column | str, confidence: Column | float) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
                    (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), F.lit("local").alias("source"))


def findings(thresholds: dict) -> Column:
    """All findings of an ordinary page, in the order of the rules. Reads the metrics by their names."""
    m, t = F.col, thresholds
    high, medium = F.lit("high"), F.lit("medium")
    near_blank = m("text_ink_coverage") < t["near_blank_ink_coverage"]
    grey = ~m("is_bitonal")
    sharp = m("stroke_sharpness")
    contrast = m("ink_paper_contrast")
    many = m("text_component_count") >= t["orientation_min_components"]
    sure = m("rotation_confidence")
    turned = many & m("rotation_deg").isin(90, 270)
    tiles = m("low_contrast_tiles") / m("tile_count")
    edges = F.size(F.array_distinct(m("cutoff_edges")))
    rules = [
        F.when(near_blank, _finding("NEAR_BLANK", "low", 0.6)),
        F.when(m("is_bitonal"), _finding("BITONAL_LOSS", "medium", 0.95)),
        F.when(grey & (m("ink_coverage") >= t["sharpness_min_ink_coverage"]) & (sharp > 0),
               F.when(sharp < t["sharpness_severe"], _finding("BLUR", "high", 0.8)).when(sharp < t["sharpness_min"], _finding("BLUR", "medium", 0.6))),
        F.when(~near_blank, F.when(contrast < t["faint_severe_contrast"], _finding("FAINT", "high", 0.85))
               .when(contrast < t["faint_ink_paper_contrast"], _finding("FAINT", "medium", 0.65))
               .when(contrast < t["low_contrast_ink_paper"], _finding("LOW_CONTRAST", "medium", 0.6))),
        F.when(m("median_luma") < t["dark_severe_median_luma"], _finding("DARK", "high", 0.85)).when(m("median_luma") < t["dark_median_luma"], _finding("DARK", "medium", 0.65)),
        F.when(grey, F.when(m("noise_sigma") > t["noise_sigma_severe"], _finding("NOISE", "high", 0.75))
               .when((m("noise_sigma") > t["noise_sigma"]) & (m("snr") < t["min_snr"]), _finding("NOISE", "medium", 0.6))),
        F.when(turned, F.when(sure >= t["rotation_confident"], _finding("ROTATED", "high", F.bround(F.least(F.lit(0.95), 0.35 + sure), 2)))
               .when(sure >= t["rotation_uncertain"], _finding("ROTATED", "medium", F.bround(sure, 2)))),
        F.when(many, F.when(F.abs("skew_deg") >= t["skew_severe_deg"], _finding("SKEWED", "high", 0.8)).when(F.abs("skew_deg") >= t["skew_deg"], _finding("SKEWED", "low", 0.6))),
        F.when(m("glare_area_fraction") > t["glare_area_fraction"], _finding("GLARE", F.when(m("glare_area_fraction") > t["glare_area_fraction_severe"], high).otherwise(medium), 0.7)),
        F.when((m("shadow_area_fraction") > t["shadow_area_fraction"]) | (m("illumination_ratio") > t["illumination_ratio"]), _finding("SHADOW", "medium", 0.65)),
        F.when((m("tile_count") >= 4) & (tiles > t["unreadable_tile_fraction"]), _finding("UNREADABLE_REGION", F.when(tiles > SEVERE_TILES, high).otherwise(medium), 0.7)),
        F.when((m("est_text_height_px") > 0) & (m("est_text_height_px") < t["min_text_height_px"]), _finding("LOW_RESOLUTION", "medium", 0.55)),
        F.when(edges > 0, _finding("SUSPECTED_CUTOFF", F.when(edges >= 2, high).otherwise(medium), 0.6)),
    ]
    return F.array_compact(F.array(*rules)).cast(f"array<{FINDING}>")


def penalty(found: Column) -> Column:
    weight = lambda s: F.when(s == "high", WEIGHTS["high"]).when(s == "medium", WEIGHTS["medium"]).otherwise(WEIGHTS["low"])
    return F.aggregate(found, F.lit(0.0), lambda a, f: a + weight(f["severity"]))


def classified(found: Column, thresholds: dict) -> tuple[Column, Column]:
    """(class, score) that findings alone give."""
    p = penalty(found)
    forced = F.exists(found, lambda f: (f["severity"] == "high") & f["code"].isin(*LEGIBILITY))
    overall = (F.when(forced | (p >= thresholds["rescan_severity_score"]), "rescan").when(p >= thresholds["review_severity_score"], "review").otherwise("acceptable"))
    return overall, F.bround(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), p / 12)), 3)


def judge(metrics: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Adds ``findings``, ``overall``, ``score`` and ``thresholds_hash``.

    Pages that couldn't be measured (an error or no size) fail; dark frames without content are to be scanned again; blank pages have no findings.
    """
    t = merged(overrides)
    m = F.col
    failed = m("error").isNotNull() | (m("width") == 0) | (m("height") == 0)
    thin = m("text_ink_coverage") < t["blank_ink_coverage"]
    dark = (m("median_luma") < t["dark_severe_median_luma"]) & thin
    blank = thin & (m("text_component_count") < t["blank_component_count"])
    none = F.array().cast(f"array<{FINDING}>")
    found = F.when(failed, none).when(dark, F.array(_finding("DARK", "high", 0.9)).cast(f"array<{FINDING}>")).when(blank, none).otherwise(findings(t))
    with_findings = metrics.withColumn("findings", found)
    overall, score = classified(m("findings"), t)
    return with_findings.withColumns({
        "overall": F.when(failed, "failed").when(dark, "rescan").when(blank, "blank").otherwise(overall),
        "score": F.when(failed | dark, 0.0).when(blank, 1.0).otherwise(score),
        "thresholds_hash": F.lit(thresholds_hash(t))})


def with_provider(rows: DataFrame, defects: str = "provider_defects", rotation_checked: bool = False, overrides: dict | None = None) -> DataFrame:
    """Put a provider's defects (type, confidence) behind the local findings and classify again; unknown types are skipped.

    Where the provider has checked the orientation, local rotation findings go.
    """
    code = F.create_map(*[F.lit(x) for k, v in PROVIDER_CODES.items() for x in (k, v)])
    sure = lambda d: F.coalesce(d["confidence"], F.lit(0.0))
    severity = lambda c: F.when(c >= 0.75, "high").when(c >= 0.45, "medium").otherwise("low")
    theirs = F.transform(F.filter(F.coalesce(F.col(defects), F.array().cast("array<struct<type:string,confidence:double>>")), lambda d: F.try_element_at(code, d["type"]).isNotNull()),
                         lambda d: F.struct(F.try_element_at(code, d["type"]).alias("code"), severity(sure(d)).alias("severity"), sure(d).alias("confidence"), F.lit("provider").alias("source")))
    ours = F.filter("findings", lambda f: f["code"] != "ROTATED") if rotation_checked else F.col("findings")
    merged_ = rows.withColumn("findings", F.concat(ours, theirs.cast(f"array<{FINDING}>")))
    overall, score = classified(F.col("findings"), merged(overrides))
    return merged_.withColumns({"overall": overall, "score": score})


def reason(found: Column, fallback: Column) -> Column:
    """Labels with severities, each code once where it is first seen, joined by ``; ``; ``fallback`` without findings."""
    label = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    codes = F.array_distinct(F.transform(found, lambda f: f["code"]))
    first = F.transform(codes, lambda c: F.filter(found, lambda f: f["code"] == c)[0])
    text = F.array_join(F.transform(first, lambda f: F.concat(F.coalesce(F.try_element_at(label, f["code"]), f["code"]), F.lit(" ("), f["severity"], F.lit(")"))), "; ")
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def applied_settings(values: dict) -> tuple[dict, list[str]]:
    """(thresholds, rejected keys) of a change: known keys take the default's type; unknown keys and unreadable values are rejected."""
    fine, rejected = {}, []
    for key, value in values.items():
        try:
            fine[key] = type(THRESHOLDS[key])(value)
        except (KeyError, TypeError, ValueError):
            rejected.append(key)
    return THRESHOLDS | fine, sorted(rejected)
