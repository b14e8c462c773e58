"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, htmltext, jaccard, langid, licenses, negatives, quality, resample, topk, toxicity, unigram, urlfilter, warc
from foliospark.llm.common import crc_part


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    found = langid.identify(_table(spark, sf_dir, "documents"), train=crc_part("doc_id", 4) != 2)
    return found.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=crc_part("doc_id", 5) != 0)
    return scored.select("doc_id", (crc_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels whose crc32(doc_id) mod 3 is not 1."""
    scored = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=crc_part("doc_id", 3) != 1)
    return scored.select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back and in the order of the merged index."""
    index = warc.archive_and_index(_table(spark, sf_dir, "pages"), least=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(5 * (j // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""


def op4_unigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again."""
    return unigram.encode(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every vector whose id is divisible by 100."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item of which it holds at least 0.8."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP7_SQL = """
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM t),
s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM s d JOIN s i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(shared AS INTEGER) AS shared, shared / n AS containment
FROM c JOIN n USING (item_id) WHERE shared >= 0.8 * n
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of every document: 4-word shingles, similarity of at least 85 / 100."""
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), words=4, percent=85)


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: w[i:i + 3])) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = doc_id GROUP BY doc_id
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and passages of every document."""
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 negatives of each of the 5 positives of every vector whose id is divisible by 100."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), anchors=F.col("vec_id") % 100 == 0, label=shifted)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, towards the benchmark's words."""
    drawn = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is spelled out: a table of 256 steps by rule, then one look-up a byte, once for each distinct word.
OP13_SQL = """
WITH t AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step FROM range(0, 256) r(i)),
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents),
dw AS (SELECT no, w, count(*) AS n FROM (SELECT no, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+')) AS w FROM benchmark) GROUP BY 1),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (
  SELECT w, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
                            lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM h, t),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (w) GROUP BY 1),
u AS (SELECT bucket, sum(n) AS t FROM bw JOIN b USING (w) GROUP BY 1),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM dw) + 10000)
                                      / (CAST((coalesce(s, 0) + 1) AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM bw) + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN u USING (bucket)),
f AS (SELECT no, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
r AS (
  SELECT no, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (no)),
k AS (SELECT no, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (no)
"""


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_toxicity, op3_warc_index, op4_unigram_tokens, op5_main_text, op6_exact_top_k, op7_decontamination, op8_jaccard_join, op9_url_filter, op10_quality,
    op11_license_scan, op12_hard_negatives, op13_importance_resampling)}
ORACLES: dict[str, str] = {"op3_warc_index": OP3_SQL, "op6_exact_top_k": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_jaccard_join": OP8_SQL,
                           "op12_hard_negatives": OP12_SQL, "op13_importance_resampling": OP13_SQL}
