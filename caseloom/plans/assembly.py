"""Registered queries of links, preservation, review conversion, catalogs and recovery over the driver's tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import annotations, cases, exports, recovery
from caseloom.plans.catalog import _records, _t
from caseloom.plans.relations import _REVIEWS, _reviews

GROUPS = ("label", "intent", "outcome")


def g1_case_links(spark, sf_dir):
    """Posts link to the next thread with a cue, comments to later ones without, every fifth post is a crosspost."""
    c = _t(spark, sf_dir, "conversations")
    post, thread = F.col("turn") == 0, F.concat(F.lit("t3_"), "conv_id")
    r = c.select(
        F.when(post, thread).otherwise(F.concat(F.lit("t1_"), "conv_id", F.lit("x"), "turn")).alias("typed_id"), thread.alias("thread_id"), F.when(post, "submissions").otherwise("comments").alias("kind"), F.col("role").alias("author"), F.lit("user").alias("original_author"),
        F.lit(None).cast("string").alias("title"), F.when(post, F.concat(F.lit("😀 My first post: https://redd.it/"), F.col("conv_id") + 1, F.lit(" and more"))).alias("selftext"),
        F.when(~post, F.concat(F.lit("(https://old.reddit.com/r/x/comments/"), F.col("conv_id") + F.col("turn"), F.lit("/t/) my previous update"))).alias("body"), F.when(post & (F.col("conv_id") % 5 == 0), F.concat(F.lit("t3_"), F.col("conv_id") + 7)).alias("crosspost_parent"),
    )
    return cases.case_links(r).select("source_record_id", "source_thread", "target_thread", "field", "url", F.col("url_start").cast("long").alias("url_start"), "relationship", "supported")


_ID = "CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || 'x' || turn END"
_G1 = f"""
SELECT {_ID} AS source_record_id, 't3_' || conv_id AS source_thread, 't3_' || (conv_id + 1) AS target_thread, 'selftext' AS field, 'https://redd.it/' || (conv_id + 1) AS url, CAST(17 AS BIGINT) AS url_start, 'points_to_earlier_post' AS relationship, true AS supported FROM conversations WHERE turn = 0
UNION ALL SELECT {_ID}, 't3_' || conv_id, 't3_' || (conv_id + turn), 'body', 'https://old.reddit.com/r/x/comments/' || (conv_id + turn) || '/t/', 1, CASE WHEN role = 'user' THEN 'points_to_earlier_post' ELSE 'unverified_related_candidate' END, role = 'user' FROM conversations WHERE turn > 0
UNION ALL SELECT {_ID}, 't3_' || conv_id, 't3_' || (conv_id + 7), 'crosspost_parent', NULL, NULL, 'attributed_crosspost', true FROM conversations WHERE turn = 0 AND conv_id % 5 = 0
"""


def g2_preservation(spark, sf_dir):
    """Every third comment repeats its thread's post after a cue; AutoModerator writes where the turn is 1."""
    r = _records(spark, sf_dir)
    own = r.where("kind = 'submissions'").select("thread_id", F.col("selftext").alias("post"))
    r = r.join(own, "thread_id", "left").withColumn("body", F.when((F.col("kind") == "comments") & (F.col("created_utc") % 3 == 1), F.concat(F.lit("Copy of the original post: "), "post", F.lit(" end"))).otherwise(F.col("body")))
    r = r.withColumn("author", F.when((F.col("kind") == "comments") & (F.col("created_utc") == 1), "AutoModerator").otherwise(F.col("author")))
    out = cases.preservation(r.withColumn("seed_key", F.col("thread_id")))
    return out.select("seed_key", "post_id", "source_record_id", "field", "type", "detection_status", "completeness", F.col("created_utc").cast("long").alias("created_utc"))


_G2 = r"""
WITH p AS (SELECT conv_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS own, text FROM conversations WHERE turn = 0),
m AS (SELECT p.conv_id, c.turn, p.own, CASE WHEN c.turn % 3 = 1 THEN 'Copy of the original post: ' || p.text || ' end' ELSE c.text END AS body, c.turn % 3 = 1 AS cue FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn > 0),
f AS (SELECT *, length(own) >= 100 AND contains(body, own) AS copied FROM m WHERE body <> '' AND (cue OR (length(own) >= 100 AND contains(body, own))))
SELECT 't3_' || conv_id AS seed_key, 't3_' || conv_id AS post_id, 't1_' || conv_id || 'x' || turn AS source_record_id, 'body' AS field, CASE WHEN turn = 1 THEN 'subreddit automod in comments' ELSE 'another Redditor in comments' END AS type,
  CASE WHEN copied THEN 'exact text match' ELSE 'candidate_requires_review' END AS detection_status, CASE WHEN copied THEN 'full' ELSE 'unknown' END AS completeness, turn AS created_utc FROM f
UNION ALL SELECT 't3_' || conv_id, 't3_' || conv_id, NULL, NULL, 'none observed', 'collected scope searched', NULL, NULL FROM p WHERE conv_id NOT IN (SELECT conv_id FROM f)
"""


def e4_posts_catalog(spark, sf_dir):
    posts = _t(spark, sf_dir, "documents").select(F.concat(F.lit("t3_"), "doc_id").alias("typed_id"))
    v = _reviews(spark, sf_dir).select(F.concat(F.lit("i_"), "record_id").alias("incident_id"), "label", "review_status", F.array(F.concat(F.lit("t3_"), "record_id"), F.concat(F.lit("t3_"), F.col("record_id") % 50)).alias("post_ids"))
    return exports.posts_catalog(posts, v).drop("place_rank")


_E4 = f"""
WITH {_REVIEWS}, e AS (SELECT DISTINCT 't3_' || record_id AS t, * FROM v UNION SELECT 't3_' || record_id % 50, * FROM v),
k AS (SELECT t, label, review_status, 'i_' || record_id AS i, (CASE WHEN review_status LIKE 'pending%' THEN '1' ELSE '0' END) || (CASE label WHEN 'Yes' THEN '0' WHEN 'No' THEN '1' ELSE '2' END) || 'i_' || record_id AS o FROM e),
l AS (SELECT t, string_agg(label, '; ' ORDER BY o) AS labels FROM (SELECT t, label, min(o) AS o FROM k GROUP BY ALL) GROUP BY t), s AS (SELECT t, string_agg(review_status, '; ' ORDER BY o) AS statuses FROM (SELECT t, review_status, min(o) AS o FROM k GROUP BY ALL) GROUP BY t),
i AS (SELECT t, string_agg(i, '; ' ORDER BY o) AS incident_ids, arg_min(i, o) AS place_id FROM k GROUP BY t)
SELECT 't3_' || doc_id AS typed_id, coalesce(labels, 'Not a keyword candidate') AS labels, coalesce(statuses, '') AS statuses, coalesce(incident_ids, '') AS incident_ids, coalesce(place_id, 't3_' || doc_id) AS place_id
FROM documents LEFT JOIN l ON l.t = 't3_' || doc_id LEFT JOIN s ON s.t = 't3_' || doc_id LEFT JOIN i ON i.t = 't3_' || doc_id
"""


def e7_summary(spark, sf_dir):
    hits = _records(spark, sf_dir).where(F.contains(F.coalesce("selftext", "body"), F.lit("the")))
    c = _t(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "discovery").otherwise("context").alias("stage"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("complete").alias("status"), F.col("o_orderkey").alias("scanned"))
    return exports.summary_table(hits, c, _reviews(spark, sf_dir))


_E7 = """
SELECT 'Completed discovery checkpoint rows (scopes may overlap)' AS measure, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS value FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus <> 'P'
UNION ALL SELECT 'Unique keyword-matching records', count(DISTINCT conv_id || 'x' || turn) FROM conversations WHERE contains(text, 'the') UNION ALL SELECT 'Unique keyword-hit threads', count(DISTINCT conv_id) FROM conversations WHERE contains(text, 'the')
UNION ALL SELECT 'Provisional case units', count(*) FROM labels UNION ALL SELECT 'Reviewed Yes', count(*) FILTER (quality = 1) FROM labels UNION ALL SELECT 'Reviewed No', count(*) FILTER (quality = 0) FROM labels
UNION ALL SELECT 'Reviewed Unsure', count(*) FILTER (quality IS NULL AND toxic IS DISTINCT FROM 1) FROM labels UNION ALL SELECT 'Awaiting model review', count(*) FILTER (toxic = 1) FROM labels
"""


def d3_orphans(spark, sf_dir):
    return recovery.orphans(_t(spark, sf_dir, "documents").select(F.concat(F.lit("records/"), F.col("doc_id") % 300).alias("path")), _t(spark, sf_dir, "labels").select(F.concat(F.lit("records/"), "doc_id").alias("path")))


def d3_unfinished(spark, sf_dir):
    return recovery.unfinished(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("status")))


def d13_integrity(spark, sf_dir):
    turn = F.col("turn")
    r = _t(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("x"), "turn").alias("typed_id"), F.when(turn % 5 != 4, F.col("text")).alias("json"), F.when(turn % 7 != 3, F.sha2(F.when(turn % 4 == 1, F.upper("text")).otherwise(F.col("text")), 256)).alias("content_hash"))
    return recovery.integrity(r)


def d14_reconcile(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    count = lambda x: x.groupBy(F.col("source").alias("table_name")).agg(F.count("*").alias("n"))
    return recovery.reconcile(count(d.where("source <> 'src1'")), count(d.where("doc_id % 30 > 0 AND source <> 'src2'")))


def v4_post_properties(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    p = d.select(
        F.concat(F.lit("t3_"), "doc_id").alias("typed_id"), F.col("source").alias("subreddit"), F.lit(None).cast("string").alias("canonical_permalink"), F.lit("t").alias("title"),
        F.when(k == 0, F.col("text")).when(k == 1, "[deleted]").when(k == 2, "[removed]").when(k == 3, "").alias("selftext"), F.col("doc_id").alias("created_utc"),
    )
    x = p.select(annotations.post_properties().alias("x")).select("x.*")
    return x.select("post_id", "subreddit", "permalink", "title", F.sha2("full_text", 256).alias("text_sha256"), "created_utc", "archive_text_availability")


def v5_pending(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    p = d.where("doc_id % 3 > 0").select(F.concat(F.lit("t3_"), "doc_id").alias("typed_id"), F.col("source").alias("subreddit"), F.lit("/x").alias("canonical_permalink"), F.lit("t").alias("title"), F.col("text").alias("selftext"), F.col("doc_id").alias("created_utc"))
    b = d.select(
        F.concat(F.lit("i_"), "doc_id").alias("incident_id"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("t3_"), "doc_id").alias("original_post_id"), F.lit("provisional seed thread").alias("original_resolution_status"),
        F.array(F.concat(F.lit("t3_"), "doc_id")).alias("seed_record_ids"), F.lit(1).cast("long").alias("observed_posts"),
    )
    return annotations.pending_annotations(b, p).select("incident_id", F.col("original.post_id").alias("post_id"), F.col("original.archive_text_availability").alias("availability"), "label", "review_status", F.size("evidence").cast("long").alias("evidence"), F.size("missingness").cast("long").alias("reasons"))


def _quotes(spark, sf_dir):
    c, turn = _t(spark, sf_dir, "conversations"), F.col("turn")
    quote = F.when(turn % 4 == 0, F.substring("text", 5, 20)).when(turn % 4 == 1, F.upper(F.substring("text", 5, 20))).when(turn % 4 == 2, "").otherwise(F.col("text"))
    q = c.select(F.concat("conv_id", F.lit("x"), F.when(F.col("conv_id") % 5 == 0, turn + 1000).otherwise(turn)).alias("record_id"), F.when(F.col("conv_id") % 7 == 0, "title").otherwise("body").alias("field"), quote.alias("quote"), "conv_id", "turn")
    return annotations.place_quotes(q, c.select(F.concat("conv_id", F.lit("x"), "turn").alias("record_id"), F.lit("body").alias("field"), "text"))


def v8_located_quotes(spark, sf_dir):
    return _quotes(spark, sf_dir).select("conv_id", "turn", "problem", F.col("raw_start").cast("long").alias("raw_start"), F.col("raw_end").cast("long").alias("raw_end"))


_Q = """q AS (SELECT conv_id, turn, text, conv_id % 5 = 0 AS lost, conv_id % 7 = 0 AS other, CASE turn % 4 WHEN 0 THEN substr(text, 5, 20) WHEN 1 THEN upper(substr(text, 5, 20)) WHEN 2 THEN '' ELSE text END AS quote FROM conversations),
z AS (SELECT *, CASE WHEN coalesce(quote, '') = '' THEN 'empty_quote' WHEN lost THEN 'unknown_record' WHEN other THEN 'unknown_field' WHEN instr(text, quote) = 0 THEN 'not_exact' END AS problem FROM q)"""


def v8_review_problems(spark, sf_dir):
    """Conversations as reviews: their turns are the records, the quotes above the evidence."""
    q, turn = _quotes(spark, sf_dir), F.col("turn")
    supports = F.when(turn % 3 == 0, F.array(F.lit("label"))).when(turn % 3 == 1, F.array(F.lit("intent"), F.lit("label"))).otherwise(F.array(F.lit("weather")))
    evidence = q.where("turn % 2 = 0").select(F.col("conv_id").alias("incident_id"), supports.alias("supports"), "problem")
    c = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("incident_id")).agg(F.sort_array(F.collect_list(F.col("turn").cast("string"))).alias("ids"))
    k = F.col("incident_id")
    decisions = c.select(
        "incident_id", F.when(k % 2 == 0, "Yes").otherwise("No").alias("label"), F.when(k % 3 == 0, F.slice("ids", 2, 1000)).otherwise(F.reverse("ids")).alias("reviewed_record_ids"),
        F.when(k % 4 == 0, F.array(F.lit("label"), F.lit("outcome"))).otherwise(F.array(F.lit("intent"))).alias("claimed"), F.when(k % 6 < 3, "Unclear").otherwise("Social networking").alias("original_intent"),
    )
    bundles = c.where("incident_id % 11 > 0").select("incident_id", F.col("ids").alias("record_ids"), (k % 5 == 1).alias("original_missing"))
    return annotations.review_problems(decisions, bundles, evidence, GROUPS)


_V8 = f"""
WITH {_Q}, e AS (SELECT conv_id, turn % 3 AS m, problem FROM z WHERE turn % 2 = 0), g AS (SELECT conv_id, bool_or(m < 2) AS label, bool_or(m = 1) AS intent, bool_or(m = 2) AS weather, bool_or(problem IS NOT NULL) AS bad FROM e GROUP BY conv_id),
d AS (SELECT DISTINCT conv_id AS k FROM conversations), j AS (SELECT d.k, g.* FROM d LEFT JOIN g ON g.conv_id = d.k)
SELECT k AS incident_id, 'unknown_incident' AS problem FROM d WHERE k % 11 = 0 UNION ALL SELECT k, 'records_not_covered' FROM d WHERE k % 11 > 0 AND k % 3 = 0
UNION ALL SELECT k, 'yes_without_evidence' FROM j WHERE k % 2 = 0 AND conv_id IS NULL UNION ALL SELECT k, 'quote_not_exact' FROM j WHERE bad
UNION ALL SELECT k, 'unsupported_group' FROM j WHERE CASE WHEN k % 4 = 0 THEN true ELSE NOT coalesce(intent, false) END UNION ALL SELECT k, 'unknown_group' FROM j WHERE weather
UNION ALL SELECT k, 'intent_of_missing_original' FROM d WHERE k % 11 > 0 AND k % 5 = 1 AND k % 6 >= 3
"""

NAMES = [k for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_"]
QUERIES = {k: globals()[k] for k in NAMES}
ORACLE = {
    "g1_case_links": _G1, "g2_preservation": _G2, "e4_posts_catalog": _E4, "e7_summary": _E7, "v8_review_problems": _V8,
    "d3_orphans": "SELECT DISTINCT 'records/' || doc_id % 300 AS path FROM documents WHERE doc_id % 300 NOT IN (SELECT doc_id FROM labels)",
    "d3_unfinished": "SELECT o_custkey AS path FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') = 0",
    "d13_integrity": """SELECT conv_id || 'x' || turn AS typed_id, CASE WHEN turn % 5 = 4 OR text IS NULL THEN 'no_content' WHEN turn % 7 = 3 THEN 'no_hash' ELSE 'hash_differs' END AS reason FROM conversations
WHERE turn % 5 = 4 OR text IS NULL OR turn % 7 = 3 OR (turn % 4 = 1 AND upper(text) <> text)""",
    "d14_reconcile": """WITH a AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 30 > 0 AND source <> 'src2' GROUP BY 1)
SELECT coalesce(a.source, b.source) AS table_name, a.n AS expected, b.n AS actual FROM a FULL JOIN b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n""",
    "v4_post_properties": """SELECT 't3_' || doc_id AS post_id, source AS subreddit, CAST(NULL AS VARCHAR) AS permalink, 't' AS title, sha256(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '[deleted]' WHEN 2 THEN '[removed]' WHEN 3 THEN '' END) AS text_sha256, doc_id AS created_utc,
  CASE doc_id % 5 WHEN 0 THEN CASE WHEN text = '' THEN 'empty' ELSE 'text' END WHEN 1 THEN 'deleted placeholder' WHEN 2 THEN 'removed placeholder' WHEN 3 THEN 'empty' ELSE 'missing' END AS archive_text_availability FROM documents""",
    "v5_pending": """SELECT 'i_' || doc_id AS incident_id, CASE WHEN doc_id % 3 > 0 THEN 't3_' || doc_id END AS post_id, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN text = '' THEN 'empty' ELSE 'text' END END AS availability, 'Unsure' AS label, 'pending_model_review' AS review_status,
  CAST(0 AS BIGINT) AS evidence, CAST(15 AS BIGINT) AS reasons FROM documents""",
    "v8_located_quotes": f"WITH {_Q} SELECT conv_id, turn, problem, CASE WHEN problem IS NULL THEN instr(text, quote) - 1 END AS raw_start, CASE WHEN problem IS NULL THEN instr(text, quote) - 1 + length(quote) END AS raw_end FROM z",
}
