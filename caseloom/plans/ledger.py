"""Registered queries of shard states, scan plans, event imports and table functions over the driver's tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import tables
from caseloom.functions import text as tx
from caseloom.operators import recovery, review, segment_review, selection, summaries
from caseloom.plans.catalog import _t
from caseloom.plans.relations import _T6


def a5_distinct_hits(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("typed_id"), F.col("event_type").alias("thread_id"))
    return summaries.hit_summary(e).select("records", "hits")


def o5_first_earlier_or_own(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return selection.first_or_own(c, "conv_id", F.contains("text", F.lit("that")), F.col("turn"), F.lit(0).cast("long"))


def c3_conflicting_events(spark, sf_dir):
    """All events, users as event ids: copies of an event that differ in type or hour stop the import."""
    e = _t(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 3).alias("event_id"), "event_type", F.hour("ts").alias("hour"))
    return review.conflicting_events(e)


def _shards(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    inventory = _t(spark, sf_dir, "customer").where(k % 10 != 7).select(k.cast("string").alias("path"), F.when(k % 9 == 0, F.lit(None)).when(k % 8 == 0, F.concat(F.lit("h"), k - 1)).otherwise(F.concat(F.lit("h"), k)).alias("content_identity"))
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    was = F.when(o % 5 == 0, "old").when(o % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("h"), F.col("o_custkey")))
    checkpoints = _t(spark, sf_dir, "orders").where("o_custkey % 3 > 0").select(F.col("o_custkey").cast("string").alias("path"), status.alias("status"), o.alias("scanned"), was.alias("content_identity"))
    return recovery.shard_states(inventory, checkpoints)


def c6_shard_states(spark, sf_dir):
    return _shards(spark, sf_dir)


def c7_mode_plans(spark, sf_dir):
    s, out = _shards(spark, sf_dir), None
    for mode in recovery.MODES:
        part = recovery.mode_plan(s, mode).select("path", F.lit(mode).alias("mode"), "action", "reason")
        out = part if out is None else out.unionByName(part)
    return out


_STATES = """i AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS path, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 8 = 0 THEN 'h' || (c_custkey - 1) ELSE 'h' || c_custkey END AS id FROM customer WHERE c_custkey % 10 <> 7),
o AS (SELECT o_custkey::VARCHAR AS path, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'old' WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'h' || o_custkey END AS was,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey DESC) AS n FROM orders WHERE o_custkey % 3 > 0),
s AS (SELECT coalesce(i.path, o.path) AS path, o.status AS original_status, i.path IS NOT NULL AS listed, (SELECT min(path) FROM i x WHERE x.id = i.id) AS first_path, i.id, o.was FROM i FULL JOIN (SELECT * FROM o WHERE n = 1) o ON i.path = o.path),
z AS (SELECT path, original_status, CASE WHEN NOT listed THEN 'source_unavailable' WHEN first_path <> path THEN 'duplicated' WHEN original_status IS NULL THEN 'missing' WHEN id IS NULL OR was IS NULL THEN 'unverifiable' WHEN id <> was THEN 'changed' ELSE original_status END AS current_status,
  CASE WHEN listed AND first_path <> path THEN first_path END AS same_as FROM s)"""


def x2_find_phrases(spark, sf_dir):
    """The matches of t6, by a table function in SQL."""
    phrases = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), tx.normalize_column(F.col("text")).alias("normalized"))
    tables.register_phrases(spark, phrases, "benchmark_phrases")
    return spark.sql("SELECT doc_id, h.query_id, CAST(h.start AS BIGINT) AS raw_start, CAST(h.end AS BIGINT) AS raw_end, h.quote FROM {docs}, LATERAL benchmark_phrases(text) AS h", docs=_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (a5_distinct_hits, o5_first_earlier_or_own, c3_conflicting_events, c6_shard_states, c7_mode_plans, x2_find_phrases)}
ORACLE = {
    "a5_distinct_hits": "SELECT count(DISTINCT user_id) AS records, count(*) AS hits FROM events",
    "o5_first_earlier_or_own": "SELECT conv_id, coalesce(min(turn) FILTER (contains(text, 'that')), 0) AS original FROM conversations GROUP BY conv_id",
    "c3_conflicting_events": "SELECT user_id * 100 + event_id % 3 AS event_id, count(DISTINCT (event_type, hour(ts))) AS contents FROM events GROUP BY 1 HAVING count(DISTINCT (event_type, hour(ts))) > 1",
    "c6_shard_states": f"WITH {_STATES} SELECT * FROM z",
    "c7_mode_plans": f"""WITH {_STATES} SELECT path, mode, CASE WHEN current_status = 'source_unavailable' THEN 'none' WHEN mode = 'full' THEN 'scan' WHEN current_status = 'complete' THEN CASE mode WHEN 'incremental' THEN 'skip' ELSE 'reuse' END WHEN current_status = 'duplicated' THEN 'skip' WHEN mode = 'incremental' THEN 'scan' ELSE 'defer' END AS action,
  CASE WHEN current_status = 'source_unavailable' THEN current_status WHEN mode = 'full' THEN 'full_scan_requested' WHEN current_status = 'complete' THEN 'complete_and_compatible' WHEN current_status = 'duplicated' THEN 'same_content_as:' || same_as WHEN current_status = 'partial' THEN 'partial_restarts' WHEN current_status = 'missing' THEN 'no_checkpoint' ELSE current_status END AS reason
FROM z, (VALUES ('incremental'), ('full'), ('local_reuse')) m(mode)""",
    "x2_find_phrases": f"SELECT doc_id, query_id, raw_start, raw_end, quote FROM ({_T6})",
}


def v16_segment_review(spark, sf_dir):
    """Documents reviewed segment by segment by the synthetic rule."""
    segs = segment_review.case_segments(_t(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    return segment_review.review(segs, segment_review.RuleAnnotator(("http", "password", "the "))).drop("method", "failed")


QUERIES["v16_segment_review"] = v16_segment_review
# the first cue that a segment shows whole; segments start every 840 characters and overlap by 160, so each cue lies whole in some
ORACLE["v16_segment_review"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, i, substr(t, i * 840 + 1, 1000) AS t FROM (SELECT doc_id, t, unnest(range(0, (greatest(length(t), 1) - 1) // 840 + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, [x for x in [{'a': instr(t, 'http'), 'q': 'http'}, {'a': instr(t, 'password'), 'q': 'password'}, {'a': instr(t, 'the '), 'q': 'the '}] if x.a > 0] AS hits FROM s),
g AS (SELECT doc_id, count(*) AS reviewed, min(i) FILTER (len(hits) > 0) AS i FROM f GROUP BY doc_id)
SELECT g.doc_id::VARCHAR AS case_id, CASE WHEN g.i IS NULL THEN 'Unsure' ELSE 'Yes' END AS label, list_sort(f.hits)[1].q AS quote, g.i * 840 + list_sort(f.hits)[1].a - 1 AS raw_start, reviewed FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.i = g.i
"""
