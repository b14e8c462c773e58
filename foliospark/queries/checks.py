"""Queries on completeness checks, profiles and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.text import directory, masked
from foliospark.operators import checks, profiling
from foliospark.plans.records import from_tables
from foliospark.queries import query

from foliospark.sources import files
from foliospark.streaming import jobs


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def exact_duplicates(spark, sf_dir):
    return checks.exact_duplicates(_t(spark, sf_dir, "documents"), "source", F.col("text"), ["doc_id"]).select("doc_id", "source")


_HASH = "list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END))::BIGINT"


#: Each vector's hash, and a copy of it with two bits changed.
_PLANTED = f"v AS (SELECT vec_id AS id, {_HASH} AS hash FROM embeddings), h AS (SELECT * FROM v UNION ALL SELECT id + 1000000000, xor(xor(hash, CAST(1 AS BIGINT) << CAST(id % 63 AS INTEGER)), CAST(1 AS BIGINT) << CAST(id % 31 AS INTEGER)) FROM v)"


def _planted(spark, sf_dir):
    hashes = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), checks.sign_hash(F.col("embedding")).alias("hash"), "label")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % n).cast("int"))
    return hashes.unionByName(hashes.select((F.col("id") + 1_000_000_000).alias("id"), F.col("hash").bitwiseXOR(bit(63)).bitwiseXOR(bit(31)).alias("hash"), "label"))


@query(f"WITH {_PLANTED} SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM h x JOIN h y ON x.id < y.id WHERE bit_count(xor(x.hash, y.hash)) <= 6")
def near_duplicates_hamming(spark, sf_dir):
    return checks.near_pairs(_planted(spark, sf_dir))


@query()
def near_duplicate_leaders(spark, sf_dir):
    return checks.leaders(_planted(spark, sf_dir).select(F.col("label").alias("case_id"), F.col("id").alias("ordinal"), F.col("id").alias("page_id"), "hash"))


@query("""WITH n AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, list(DISTINCT l_linenumber) AS seen FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 3),
m AS (SELECT l_orderkey, list_filter(range(lo, hi + 1), lambda x: NOT list_contains(seen, x)) AS missing FROM n)
SELECT l_orderkey, CAST(len(missing) AS INTEGER) AS n_missing, array_to_string(missing[1:50], ',') AS missing FROM m WHERE len(missing) > 0""")
def sequence_gaps(spark, sf_dir):
    return checks.sequence_gaps(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_ITEMS, _ITEM = [("HIGH", 2, True), ("URGENT", 1, True), ("LOW", 3, False)], "doc_type string, min_pages int, required boolean"


def _checked_files(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.concat("o_orderpriority", F.lit(".pdf")).alias("filename"), F.lit(1).alias("pages"))


@query("""WITH i(doc_type, min_pages, required) AS (VALUES ('HIGH', 2, true), ('URGENT', 1, true), ('LOW', 3, false)),
c AS (SELECT o_custkey AS case_id, doc_type, CAST(sum(CASE WHEN contains(lower(o_orderpriority), lower(doc_type)) THEN 1 ELSE 0 END) AS BIGINT) AS pages, min_pages, required FROM orders, i GROUP BY ALL)
SELECT *, CASE WHEN required AND pages = 0 THEN 'missing' WHEN pages > 0 AND pages < min_pages THEN 'too_few' ELSE 'ok' END AS state FROM c""")
def checklist_coverage(spark, sf_dir):
    return checks.checklist_coverage(_checked_files(spark, sf_dir), spark.createDataFrame(_ITEMS, _ITEM))


@query("""WITH k AS (SELECT c_custkey, c_mktsegment <> 'MACHINERY' AS listed FROM customer),
c AS (SELECT c_custkey AS case_id, listed, count(*) FILTER (contains(o_orderpriority, 'HIGH')) AS h, count(*) FILTER (contains(o_orderpriority, 'URGENT')) AS u, count(*) FILTER (contains(o_orderpriority, 'LOW')) AS l
  FROM k LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT case_id, CASE WHEN NOT listed THEN 'not_verified' WHEN h < 2 OR u < 1 OR l BETWEEN 1 AND 2 THEN 'incomplete' ELSE 'verified' END AS status FROM c""")
def completeness_status(spark, sf_dir):
    """Cases of one segment have no checklist; cases without documents lack all that is required."""
    cases = from_tables(spark, sf_dir).cases
    coverage = checks.checklist_coverage(_checked_files(spark, sf_dir), spark.createDataFrame(_ITEMS, _ITEM), cases.filter("encounter_ref <> 'MACHINERY'"))
    return checks.completeness(coverage, cases)


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def retention_due(spark, sf_dir):
    return checks.retention_due(from_tables(spark, sf_dir).documents, F.lit("1998-01-01").cast("timestamp_ntz"), 365).select("document_id")


@query("WITH w AS (SELECT l_suppkey, l_discount AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_discount) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS t FROM lineitem) SELECT l_suppkey, min(v) AS median FROM w WHERE c * 2 >= t GROUP BY 1")
def weighted_median(spark, sf_dir):
    return checks.weighted_median(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", "l_quantity")


def _profile(c: str) -> str:
    return f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS largest FROM events"


@query(" UNION ALL ".join(map(_profile, ("event_id", "user_id", "event_type", "props"))))
def profile_columns(spark, sf_dir):
    return profiling.columns_profile(_t(spark, sf_dir, "events"), ["event_id", "user_id", "event_type", "props"])


@query("SELECT length(url) AS length, count(*) AS rows, bool_or(regexp_matches(url, '[0-9]')) AS digits, bool_or(contains(url, '/')) AS slashes, bool_or(contains(url, '-')) AS dashes, min(url) AS first, max(url) AS last FROM pages GROUP BY 1")
def profile_lengths(spark, sf_dir):
    return profiling.lengths(_t(spark, sf_dir, "pages"), F.col("url"))


@query("WITH t AS (SELECT regexp_extract(url, '/([^/?#]*)[?#]?[^/]*$', 1) AS x FROM pages) SELECT count(x) AS values, count(*) FILTER (x IS NOT NULL AND NOT regexp_full_match(x, '[0-9]+')) AS unparseable, CAST(sum(CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) END) AS BIGINT) AS total FROM t")
def unparseable_count(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", r"/([^/?#]*)[?#]?[^/]*$", 1).alias("x"))
    return profiling.unparseable(rows, F.col("x"), "bigint")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS grp FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name, NULL FROM nation")
def union_all_sources(spark, sf_dir):
    one = lambda t, p, g: _t(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(f"{p}key").cast("long").alias("id"), F.col(f"{p[0]}_name").alias("name"), g.alias("grp"))
    none = F.lit(None).cast("string")
    return one("customer", "c_cust", F.col("c_mktsegment")).unionByName(one("supplier", "s_supp", none)).unionByName(one("nation", "n_nation", none))


@query("SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, count(*) AS rows FROM pages GROUP BY 1")
def path_dirname(spark, sf_dir):
    return _t(spark, sf_dir, "pages").groupBy(directory(F.col("url")).alias("directory")).agg(F.count("*").alias("rows"))


@query("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def scalar_counts(spark, sf_dir):
    return profiling.table_rows({n: _t(spark, sf_dir, n) for n in ("customer", "orders", "events", "documents", "pages")})


@query("SELECT c_custkey, left(c_name, 1) || '***(' || length(c_name) || ')' AS masked FROM customer ORDER BY c_custkey LIMIT 5")
def mask_sample(spark, sf_dir):
    return _t(spark, sf_dir, "customer").orderBy("c_custkey").limit(5).select("c_custkey", masked(F.col("c_name")).alias("masked"))


@query("SELECT count(*) AS matching FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k FROM events) WHERE k IN (SELECT json_extract_string(props, '$.k') FROM events)")
def cast_join_overlap(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return profiling.overlap_of_types(e, "user_id", e.select(F.get_json_object("props", "$.k").alias("k")), "k")


@query("""SELECT event_id, CASE WHEN late THEN (CASE WHEN attempt + 1 < 3 THEN 'queued' ELSE 'failed' END) ELSE state END AS state, CAST(CASE WHEN late THEN attempt + 1 ELSE attempt END AS INTEGER) AS attempt FROM (
  SELECT event_id, CAST(event_id % 3 AS INTEGER) AS attempt, CASE event_type WHEN 'click' THEN 'running' ELSE 'queued' END AS state,
    event_type = 'click' AND (event_id % 5 = 0 OR ts < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE) AS late FROM events)""")
def stalled_sweep(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("attempt"), F.when(F.col("event_type") == "click", "running").otherwise("queued").alias("state"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("heartbeat_at"))
    return jobs.stalled_sweep(e, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "state", "attempt")


@query("SELECT page_id, kind, sha256(kind || '|' || page_id || '||') AS job_key FROM pages, (VALUES ('quality'), ('handwriting'), ('diagnosis')) k(kind)")
def stage_fanout(spark, sf_dir):
    return jobs.fan_out(_t(spark, sf_dir, "pages").select("page_id")).select("page_id", "kind", "job_key")


@query()
def job_states_replayed(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "succeed").when(F.col("event_type") == "error", "fail").otherwise("cancel")
    return jobs.replayed(e.select(F.col("user_id").cast("string").alias("job_key"), event.alias("event"), F.col("ts").alias("at"), "event_id"))


@query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'view') ORDER BY ts, event_id LIMIT 100")
def dispatch_fifo(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("job_id"), F.col("ts").alias("queued_at"), F.when(F.col("event_type") == "view", "queued").otherwise("running").alias("state"))
    return jobs.dispatch(e, 100).select("event_id")


@query("""WITH u AS (SELECT o_orderkey, 'scan.' || CASE o_orderkey % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'tiff' WHEN 2 THEN 'exe' WHEN 3 THEN 'jpg' ELSE 'png' END AS name, CAST(o_totalprice * 1000 AS BIGINT) - 50000000 AS size FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN 'unsupported_type' WHEN size <= 0 THEN 'empty' WHEN size > 209715200 THEN 'too_large' END AS reason,
CASE o_orderkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM u""")
def upload_validation(spark, sf_dir):
    kinds = F.get(F.array(*map(F.lit, ("PDF", "tiff", "exe", "jpg", "png"))), (F.col("o_orderkey") % 5).cast("int"))
    u = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("scan."), kinds).alias("name"), (F.bround(F.col("o_totalprice") * 1000, 0).cast("long") - 50_000_000).alias("size"))
    return u.select("o_orderkey", files.validated(F.col("name"), F.col("size")).alias("reason"), files.mime(F.col("name")).alias("mime"))


