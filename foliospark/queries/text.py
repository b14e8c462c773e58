"""Queries on text extraction and recognised text."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.text import redacted, script, without_uuids
from foliospark.operators import extract
from foliospark.queries import query
from foliospark.sources import ocr


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END AS script FROM documents")
def script_hint(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", script(F.col("text")).alias("script"))


_CLEAN = """WITH a AS (SELECT doc_id, ' :- ' || text AS t0 FROM documents), b AS (SELECT *, regexp_replace(t0, '^\\s+|\\s+$', '', 'g') AS t1 FROM a), c AS (SELECT *, regexp_replace(t1, '[ \\t]{2,}', ' ', 'g') AS t2 FROM b),
d AS (SELECT *, regexp_replace(t2, '^[\\s:.\\-–—]+', '') AS t3 FROM c), e AS (SELECT *, regexp_replace(t3, '\\s*\\n\\s*', ' ', 'g') AS t4 FROM d)"""


@query(_CLEAN + """ SELECT doc_id, t4 AS cleaned, array_to_string(list_filter([CASE WHEN t1 <> t0 THEN 'trimmed surrounding whitespace' END, CASE WHEN t2 <> t1 THEN 'collapsed repeated spaces' END,
CASE WHEN t3 <> t2 THEN 'removed leading label punctuation' END, CASE WHEN t4 <> t3 THEN 'joined wrapped lines' END], lambda x: x IS NOT NULL), ',') AS steps FROM e""")
def text_clean_audit(spark, sf_dir):
    text, steps = extract.cleaned(F.concat(F.lit(" :- "), "text"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("cleaned"), F.array_join(steps, ",").alias("steps"))


@query()
def split_pieces(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(extract.pieces(F.col("text"))).alias("n", "piece"))


@query("""WITH c AS (SELECT doc_id, lower(CASE doc_id % 7 WHEN 0 THEN 'r/o TB' WHEN 1 THEN 'K/C/O diabetes' WHEN 2 THEN 'd/d sepsis' WHEN 3 THEN 'suspected ' WHEN 4 THEN 'provisional ' WHEN 5 THEN 'no evidence of ' ELSE 'x' END || ' ' || text) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '\\br/?o\\b|\\brule[d]?\\s+out\\b') THEN 'ruled_out' WHEN regexp_matches(t, '\\bk/?c/?o\\b|\\bknown\\s+case\\s+of\\b|\\bh/?o\\b|\\bpast\\s+history\\b|\\bs/?p\\b|\\bstatus\\s+post\\b') THEN 'past_history'
WHEN regexp_matches(t, '\\bd/?d\\b|\\bdifferential\\b') THEN 'differential' WHEN regexp_matches(t, '\\bsusp(?:ected|icion)?\\b|\\?\\s*\\w') THEN 'suspected' WHEN regexp_matches(t, '\\bprovisional\\b') THEN 'provisional'
WHEN regexp_matches(t, '\\bno\\s+evidence\\s+of\\b|\\bnot\\s+\\w+\\b|\\bnegative\\s+for\\b') THEN 'negated' WHEN regexp_matches(t, '\\bconfirmed\\b|\\bfinal\\b') THEN 'final' ELSE 'unspecified' END AS qualifier FROM c""")
def qualifier_precedence(spark, sf_dir):
    cues = F.get(F.array(*map(F.lit, ("r/o TB", "K/C/O diabetes", "d/d sepsis", "suspected ", "provisional ", "no evidence of ", "x"))), (F.col("doc_id") % 7).cast("int"))
    text = F.concat(cues, F.lit(" "), "text")
    return _t(spark, sf_dir, "documents").select("doc_id", extract.qualifier(text, F.lit("unspecified")).alias("qualifier"))


_ABBREVIATED = "CASE doc_id % 4 WHEN 0 THEN 'TB with HTN ' WHEN 1 THEN 'MI/CA, D/M, COPD ' WHEN 2 THEN 'tb HTNX ' ELSE '' END || regexp_replace(upper(text), '[^\\x00-\\x7F]', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all({_ABBREVIATED}, '\\b([A-Z][A-Z/]{{1,6}})\\b', 1), lambda x: replace(x, '/', '')) AS x FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: v IN ({', '.join(f"'{a}'" for a in extract.ABBREVIATIONS)})))), ',') AS flags FROM t""")
def abbreviation_flags(spark, sf_dir):
    heads = F.get(F.array(*map(F.lit, ("TB with HTN ", "MI/CA, D/M, COPD ", "tb HTNX ", ""))), (F.col("doc_id") % 4).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(extract.abbreviations(F.concat(heads, F.regexp_replace(F.upper("text"), r"[^\x00-\x7F]", ""))), ",").alias("flags"))


@query("""WITH t AS (SELECT doc_id, text AS x, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0 END AS c FROM documents), s AS (SELECT *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM t)
SELECT doc_id, CASE WHEN NOT (length(t) >= 2 AND length(regexp_replace(t, '[^\\pL]', '', 'g')) / greatest(length(t), 1) >= 0.45 AND coalesce(c >= 0.35, true)) THEN 'unreadable' WHEN coalesce(c < 0.6, false) THEN 'uncertain' ELSE 'extracted_pending_review' END AS status FROM s""")
def legibility_status(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("x"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / F.lit(10.0)).alias("c"))
    return rows.select("doc_id", extract.status(extract.readable(F.col("x"), F.col("c")), F.col("c")).alias("status"))


@query(f"""WITH a AS (SELECT doc_id, {_ABBREVIATED} AS x, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0 END AS c, doc_id % 4 > 0 AS found, doc_id % 5 = 0 AS hand FROM documents),
b AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(x, '[A-Z]', '7', 'g') WHEN doc_id % 7 = 1 THEN ' X ' ELSE x END AS y FROM a),
s AS (SELECT *, regexp_replace(y, '^\\s+|\\s+$', '', 'g') AS t, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(y, '\\b([A-Z][A-Z/]{{1,6}})\\b', 1), lambda v: replace(v, '/', '')),
  lambda v: v IN ({', '.join(f"'{a}'" for a in extract.ABBREVIATIONS)})))), ', ') AS kept FROM b),
r AS (SELECT *, CASE WHEN length(t) < 2 THEN 'transcription too short to be meaningful' WHEN length(regexp_replace(t, '[^\\pL]', '', 'g')) / greatest(length(t), 1) < 0.45 THEN 'transcription is mostly non-alphabetic characters'
  WHEN c < 0.35 THEN printf('provider confidence %.2f below the legibility floor', c) END AS reason FROM s)
SELECT doc_id, CASE WHEN NOT found THEN 'A diagnosis label is present on the page but no value was read next to it.' ELSE concat_ws(' ', CASE WHEN reason IS NOT NULL THEN 'Not transcribed with confidence: ' || reason || '. Read the highlighted region on the image.'
  WHEN c < 0.6 THEN printf('Low provider confidence (%.2f). Confirm against the image before use.', c) WHEN hand THEN 'Handwritten source — confirm the transcription against the image.' END,
  CASE WHEN kept <> '' THEN 'Contains abbreviations that were left exactly as written and not expanded: ' || kept || '.' END) END AS note FROM r""")
def extraction_notes(spark, sf_dir):
    heads = F.get(F.array(*map(F.lit, ("TB with HTN ", "MI/CA, D/M, COPD ", "tb HTNX ", ""))), (F.col("doc_id") % 4).cast("int"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.concat(heads, F.regexp_replace(F.upper("text"), r"[^\x00-\x7F]", "")).alias("x"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / F.lit(10.0)).alias("c"))
    y = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("x", "[A-Z]", "7")).when(F.col("doc_id") % 7 == 1, " X ").otherwise(F.col("x"))
    return rows.withColumn("y", y).select("doc_id", extract.note(F.col("doc_id") % 4 > 0, F.col("y"), F.col("c"), F.col("doc_id") % 5 == 0, extract.abbreviations(F.col("y"))).alias("note"))


@query("""WITH s AS (SELECT l_orderkey AS k, list({'a': l_partkey % 1000, 'b': l_partkey % 1000 + 20}) AS spans FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey, CASE WHEN spans IS NOT NULL THEN len(list_filter(spans, lambda s: o_custkey % 1000 < s.b AND o_custkey % 1000 + 10 > s.a)) > 0 END AS handwritten FROM orders LEFT JOIN s ON k = o_orderkey""")
def interval_overlap_flags(spark, sf_dir):
    start = F.col("l_partkey") % 1000
    spans = _t(spark, sf_dir, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(start.alias("start"), (start + 20).alias("end"))).alias("spans"))
    at = F.col("o_custkey") % 1000
    return _t(spark, sf_dir, "orders").join(spans, "o_orderkey", "left").select("o_orderkey", ocr.in_spans(at, at + 10, F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("handwritten"))


@query("SELECT event_id, CAST(list_min(list_transform([0, 90, 180, 270], lambda t: {'d': least((((value * 7 - t) % 360) + 360) % 360, (((t - value * 7) % 360) + 360) % 360), 't': t})).t AS INTEGER) AS turn FROM events")
def orientation_snap(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", ocr.snapped(F.col("value") * 7).cast("int").alias("turn"))


@query("""WITH w AS (SELECT l_orderkey, l_partkey % 200 AS x, l_linenumber * 12 AS y, l_suppkey % 30 AS w, l_suppkey, l_extendedprice FROM lineitem),
o AS (SELECT *, lag(x) OVER k AS px, lag(y) OVER k AS py, lag(w) OVER k AS pw FROM w WINDOW k AS (PARTITION BY l_orderkey ORDER BY round_even(y / 20.0, 0), x, y, w)),
g AS (SELECT *, CASE WHEN py IS NOT NULL AND abs(y - py) < 20 AND x - (px + pw) < 20 * 1.6 THEN 0 ELSE 1 END AS n FROM o)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS groups FROM g GROUP BY 1""")
def gap_groups(spark, sf_dir):
    words = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("x"), (F.col("l_linenumber") * 12).alias("y"), (F.col("l_suppkey") % 30).alias("w"))
    return extract.word_groups(words.repartition(extract.tasks(words), "l_orderkey"), ["l_orderkey"], F.lit(20.0)).groupBy("l_orderkey").agg((F.max("group_no") + 1).cast("long").alias("groups"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '<redacted>' ELSE props END AS value, '<id> ' || event_id AS note FROM events")
def redact_meta(spark, sf_dir):
    key = F.when(F.col("event_id") % 3 == 0, "Password").otherwise("props")
    meta = redacted(F.create_map(key, F.col("props")), ("password", "text", "raw_text"))
    uuid = F.concat(F.lit("123e4567-e89b-12d3-a456-426614174000 "), "event_id")
    return _t(spark, sf_dir, "events").select("event_id", F.map_values(meta)[0].alias("value"), without_uuids(uuid).alias("note"))


@query()
def labelled_entries(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    label = F.when(F.col("n") % 9 == 3, F.concat(F.lit("Provisional Diagnosis: "), "text")).otherwise(F.col("text"))
    page = lines.select(F.col("doc_id").alias("page_id"), label.alias("text"), F.lit(60.0).alias("x"), (F.col("n") * 40.0).alias("y"), F.lit(30.0).alias("height"), F.lit(0.9).alias("confidence"))
    return extract.entries(extract.labelled_values(page)).select("page_id", "label", "raw_text", "cleaned_text", "qualifier", "status")
