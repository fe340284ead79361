"""Registered queries of context and bundles over the driver's tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import bundles
from caseloom.operators.selection import month_of
from caseloom.plans.catalog import _t

LAST, REVISION = "1970-08", "rev1"


def _archive(spark, sf_dir):
    """Conversations as an archive by month: every tenth post is lost, each post names the next thread."""
    c, turn, post = _t(spark, sf_dir, "conversations"), F.col("turn"), F.col("turn") == 0
    thread = F.concat(F.lit("t3_"), "conv_id")
    utc = (F.col("conv_id") % 100 * 400000 + turn * 900000).cast("long")
    rows = c.select(
        "conv_id", F.when(post, thread).otherwise(F.concat(F.lit("t1_"), "conv_id", F.lit("x"), "turn")).alias("typed_id"), thread.alias("thread_id"), F.when(post, "submissions").otherwise("comments").alias("kind"), F.col("role").alias("author"), utc.alias("created_utc"), month_of(utc).alias("month"),
        F.when(post, F.concat("text", F.lit(" My first post: https://redd.it/"), F.col("conv_id") + 1)).alias("selftext"), F.when(~post, F.col("text")).alias("body"), F.lit(None).cast("string").alias("title"), F.col("text").alias("all_text"),
    )
    hits = rows.where(F.contains("all_text", F.lit(" the ")) & (F.col("conv_id") % 3 > 0)).drop("conv_id", "all_text")
    return rows.where("NOT (kind = 'submissions' AND conv_id % 10 = 3)").drop("conv_id", "all_text"), hits


def g11_context(spark, sf_dir):
    archive, seeds = _archive(spark, sf_dir)
    return bundles.collect_context(archive, seeds, seeds.where("kind = 'submissions'"), LAST)[1].drop("last_month")


def g9_bundles(spark, sf_dir):
    archive, seeds = _archive(spark, sf_dir)
    more, threads = bundles.collect_context(archive, seeds, seeds.where("kind = 'submissions'"), LAST)
    head, _ = bundles.post_bundles(seeds.unionByName(more).dropDuplicates(["typed_id"]), seeds.select("typed_id"), threads, REVISION, LAST)
    long = [F.col(c).cast("long").alias(c) for c in ("records", "retrieved_comments", "missing_submissions", "unresolved_related")]
    return head.select("incident_id", F.array_join("seed_record_ids", ",").alias("seeds"), "seed_thread_id", "original_post_id", "original_resolution_status", *long, "comments_collected", "comments_missing_reason", "complete_case")


_R = f"""all_r AS (
  SELECT conv_id, CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || 'x' || turn END AS id, 't3_' || conv_id AS thread, turn = 0 AS post, role, text,
    strftime(to_timestamp(conv_id % 100 * 400000 + turn * 900000) AT TIME ZONE 'UTC', '%Y-%m') AS m FROM conversations
), seeds AS (SELECT * FROM all_r WHERE contains(text, ' the ') AND conv_id % 3 > 0), r AS (SELECT * FROM all_r WHERE NOT (post AND conv_id % 10 = 3)),
targets AS (SELECT DISTINCT thread FROM seeds WHERE m <= '{LAST}'), w AS (SELECT max(m) AS latest FROM seeds WHERE m <= '{LAST}'),
posts AS (SELECT r.* FROM r, w WHERE post AND m <= latest AND id IN (SELECT thread FROM targets) AND id NOT IN (SELECT id FROM seeds WHERE post)),
known AS (SELECT id, m, conv_id % 100 > 0 AS timed FROM posts UNION ALL SELECT id, m, conv_id % 100 > 0 FROM seeds WHERE post),
f AS (SELECT CASE WHEN bool_and(coalesce(timed, false)) THEN min(k.m) END AS first_month FROM targets t LEFT JOIN known k ON k.id = t.thread),
comments AS (SELECT r.* FROM r, f WHERE NOT post AND thread IN (SELECT thread FROM targets) AND m >= coalesce(first_month, '') AND m <= '{LAST}')"""
_G11 = f"""WITH {_R} SELECT thread AS thread_id, thread IN (SELECT id FROM known) AS containing_post_retrieved, (SELECT count(*) FROM comments c WHERE c.thread = t.thread) AS comments, (SELECT first_month FROM f) AS first_month, true AS comments_query_complete FROM targets t"""
_G9 = f"""WITH {_R}, rec AS (SELECT conv_id, id, thread, post, role, m FROM seeds UNION SELECT conv_id, id, thread, post, role, m FROM posts UNION SELECT conv_id, id, thread, post, role, m FROM comments),
g AS (SELECT CASE WHEN s.post OR s.role = p.role THEN s.thread ELSE s.id END AS k, s.thread, string_agg(DISTINCT s.id, ',' ORDER BY s.id) AS seeds, min(s.id) AS first_id FROM seeds s LEFT JOIN rec p ON p.post AND p.id = s.thread GROUP BY 1, 2),
n AS (SELECT thread, count(*) AS records, count(*) FILTER (NOT post) AS comments, max(CASE WHEN post AND 't3_' || (conv_id + 1) NOT IN (SELECT id FROM rec) THEN 1 ELSE 0 END) AS lost, bool_or(post) AS post, min(m) FILTER (post) AS pm FROM rec GROUP BY thread)
SELECT 'i_' || substr(sha256('["{REVISION}", "' || k || '"]'), 1, 20) AS incident_id, seeds, g.thread AS seed_thread_id, CASE WHEN n.post THEN g.thread END AS original_post_id, CASE WHEN n.post THEN 'provisional seed thread' ELSE 'unresolved' END AS original_resolution_status,
  records, comments AS retrieved_comments, CAST(CASE WHEN n.post THEN 0 ELSE 1 END AS BIGINT) AS missing_submissions, CAST(lost AS BIGINT) AS unresolved_related, g.thread IN (SELECT thread FROM targets) AS comments_collected,
  CASE WHEN g.thread IN (SELECT thread FROM targets) THEN '{bundles.WINDOW}' WHEN coalesce(pm, s.m) > '{LAST}' THEN '{bundles.OUTSIDE}' ELSE '{bundles.PENDING}' END AS comments_missing_reason, false AS complete_case
FROM g JOIN n ON n.thread = g.thread JOIN seeds s ON s.id = g.first_id"""

QUERIES = {"g11_context": g11_context, "g9_bundles": g9_bundles}
ORACLE = {"g11_context": _G11, "g9_bundles": _G9}
