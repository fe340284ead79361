"""Registered queries of case assembly, annotation, export, review and recovery, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators import annotations, cases, exports, graph, recovery, review
from caseloom.sources import archive

SITE = "https://forum.example"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: turn 0 is the post, each later turn answers the one before."""
    c = _t(spark, sf_dir, "conversations")
    thread, me = F.concat(F.lit("t3_"), "conv_id"), lambda t: F.concat(F.lit("t1_"), "conv_id", F.lit("x"), t)
    post, turn = F.col("turn") == 0, F.col("turn")
    return c.select(
        F.when(post, thread).otherwise(me(turn)).alias("typed_id"), thread.alias("thread_id"), F.when(turn == 1, thread).when(turn > 1, me(turn - 1)).alias("parent_id"),
        F.when(post, "submissions").otherwise("comments").alias("kind"), F.col("role").alias("author"), turn.alias("created_utc"), F.when(post, F.col("text")).alias("selftext"), F.when(~post, F.col("text")).alias("body"),
    )


_REC = """r AS (SELECT CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || 'x' || turn END AS typed_id, 't3_' || conv_id AS thread_id,
  CASE WHEN turn = 1 THEN 't3_' || conv_id WHEN turn > 1 THEN 't1_' || conv_id || 'x' || (turn - 1) END AS parent_id, turn = 0 AS post, role, turn, text FROM conversations)"""


def g6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events linked to the same user's next event when it has the same type: components are runs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", F.lag("event_id").over(w).alias("p"), F.lag("event_type").over(w).alias("pt"))
    return graph.components(e.where("event_type = pt").select(F.col("event_id").alias("a"), F.col("p").alias("b")))


_G6 = """
WITH l AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN event_type = pt THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, run) AS component FROM g QUALIFY count(*) OVER (PARTITION BY user_id, run) > 1
"""


def g10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    members = r.select(F.col("thread_id").alias("seed_key"), F.col("thread_id").alias("thread")).distinct()
    return graph.coverage(members, r)


_G10 = f"""
WITH {_REC}
SELECT thread_id AS seed_key, CAST(1 AS BIGINT) AS threads, count(*) FILTER (post) AS posts, count(*) FILTER (NOT post) AS comments, 1 - count(*) FILTER (post) AS missing_posts,
  count(DISTINCT parent_id) FILTER (NOT post AND NOT EXISTS (SELECT 1 FROM r x WHERE x.thread_id = r.thread_id AND x.typed_id = r.parent_id)) AS missing_parents,
  count(*) FILTER (NOT post AND text IN ('[deleted]', '[removed]')) AS deleted_or_removed, false AS complete_case FROM r GROUP BY thread_id
"""


def g7_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies point at the document they copy as an earlier post; the first of these is the original."""
    d = _t(spark, sf_dir, "documents")
    c = cases.exact_copies(d, "doc_id", "text")
    t3 = lambda x: F.concat(F.lit("t3_"), x)
    edges = c.select(t3("copy_id").alias("source_thread"), t3("post_id").alias("target_thread"), F.lit("points_to_earlier_post").alias("relationship"), F.lit(True).alias("supported"))
    seeds = d.select(t3("doc_id").alias("seed_key"), t3("doc_id").alias("thread"))
    posts = d.select(t3("doc_id").alias("typed_id"), F.col("doc_id").alias("created_utc"))
    return graph.originals(seeds, graph.case_threads(seeds, edges), posts, edges)


_G7 = """
WITH t AS (SELECT doc_id, CASE WHEN length(trim(text, ' ')) >= 100 THEN trim(text, ' ') ELSE 'own ' || doc_id END AS t FROM documents)
SELECT 't3_' || doc_id AS seed_key, 't3_' || min(doc_id) OVER (PARTITION BY t) AS original_post_id, 'provisional seed thread' AS status FROM t
"""


def g12_incident_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", graph.incident_id("rev1", F.concat(F.lit("t3_"), "doc_id")).alias("incident_id"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("x"), "turn").alias("id"), F.concat(F.lit("T3_"), "conv_id").alias("link_id"), F.concat(F.lit("t3_"), "conv_id").alias("parent_id"))
    return archive.canonical(c, "comments", SITE)[0].select("typed_id", "thread_id", "parent_id", "canonical_permalink")


def s5_select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_orderstatus") == "O", "submissions").otherwise("comments").alias("kind"))
    return archive.select_files(m, ["submissions", "comments"], "1995-01", "1996-06")


def v2_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotations without evidence: quality 1 is Yes, 0 No; toxic ones are still pending."""
    label = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").otherwise("Unsure")
    a = _t(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("incident_id"), label.alias("label"), F.when(F.col("toxic") == 1, "pending_review").otherwise("reviewed").alias("review_status"), F.lit(None).cast(annotations.EVIDENCE).alias("evidence"),
        F.array(F.lit("e1")).alias("evidence_refs"), F.create_map(F.lit("label"), F.array().cast("array<string>")).alias("claim_evidence"), F.array(F.lit("stranger")).alias("relationship_subtypes"), F.col("toxic").alias("distance"), F.lit("").alias("distance_basis"),
    )
    return annotations.violations(a)


_V2 = """
SELECT CAST(doc_id AS VARCHAR) AS incident_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'yes_without_evidence' END, CASE WHEN quality IS NOT NULL AND toxic = 1 THEN 'label_before_review' END,
  CASE WHEN toxic IS NOT NULL THEN 'distance_without_basis' END, 'unknown_evidence', 'empty_or_unknown_claim'], lambda x: x IS NOT NULL)) AS rule FROM labels
"""


def v3_span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record quoted whole and in lower case: only texts without capitals are exact; empty spans are out of bounds."""
    r = _records(spark, sf_dir)
    texts = annotations.long_fields(r.select("typed_id", "thread_id", "author", F.col("created_utc"), "selftext", "body"), ("selftext", "body"))
    e = r.select(
        F.col("typed_id").alias("evidence_id"), F.col("typed_id").alias("source_record_id"), "thread_id", F.when(F.col("kind") == "submissions", "selftext").otherwise("body").alias("source_field"), F.lit(0).alias("raw_start"),
        F.length(F.coalesce("selftext", "body")).alias("raw_end"), F.lower(F.coalesce("selftext", "body")).alias("quote"), F.lit("user").alias("reporting_username"), F.col("created_utc").alias("record_created_utc"),
    )
    return annotations.span_violations(e, texts)


_V3 = f"""
WITH {_REC} SELECT typed_id AS evidence_id, CASE WHEN text = '' OR text IS NULL OR text <> lower(text) THEN 'quote_or_offset' ELSE 'metadata' END AS rule FROM r
WHERE text = '' OR text IS NULL OR text <> lower(text) OR role <> 'user'
"""


def v7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "documents").select("doc_id", F.explode(annotations.segments(F.col("text"), 3500)).alias("s"))
    return s.select("doc_id", F.col("s.raw_start").cast("long").alias("raw_start"), F.col("s.raw_end").cast("long").alias("raw_end"), F.sha2("s.text", 256).alias("segment_sha256"))


_V7 = """
WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text), 1) - 1, 3340)) AS a FROM documents)
SELECT doc_id, a AS raw_start, least(length(text), a + 3500) AS raw_end, sha256(substr(text, a + 1, 3500)) AS segment_sha256 FROM s
"""


def w6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in greedy batches of 2,000 characters."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("place"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return annotations.batches(c, 2000)


_W6 = """
WITH RECURSIVE o AS (SELECT conv_id, turn, CAST(length(coalesce(text, '')) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, turn, size, rn, size AS used, CAST(0 AS BIGINT) AS batch_id FROM o WHERE rn = 1 UNION ALL
  SELECT o.conv_id, o.turn, o.size, o.rn, CASE WHEN f.used + o.size > 2000 THEN o.size ELSE f.used + o.size END, f.batch_id + CASE WHEN f.used + o.size > 2000 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1)
SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS place, size, batch_id FROM f
"""


def v10_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bundles: toxic labels are the outside review, quality labels the cached model."""
    b = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("incident_id"), F.sha2("text", 256).alias("content_hash"))
    l = _t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "incident_id").join(b, "incident_id")  # noqa: E741
    yes = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("No").alias("label")
    pick = lambda c: l.where(F.col(c) == 1).select("incident_id", "content_hash", yes(c)).distinct()
    return annotations.precedence(b, [("external", pick("toxic")), ("model", pick("quality"))], ["label"]).drop("content_hash")


_V10 = """
WITH l AS (SELECT doc_id, max(toxic = 1) AS t, max(quality = 1) AS q FROM labels GROUP BY doc_id)
SELECT d.doc_id AS incident_id, CASE WHEN t THEN 'external' WHEN q THEN 'model' ELSE 'pending' END AS annotated_by, CASE WHEN t OR q THEN 'Yes' ELSE 'Unsure' END AS label FROM documents d LEFT JOIN l USING (doc_id)
"""


def e5_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts = exports.overlong_cells(_t(spark, sf_dir, "documents"), "doc_id", ["text", "source"])
    return parts.select("cell_row", "cell_column", "part", F.length("value").cast("long").alias("chars"), F.sha2("value", 256).alias("value_sha256"))


_E5 = """
WITH s AS (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 14000) AS BIGINT) - 1)) AS i FROM documents WHERE length(text) > 30000)
SELECT doc_id AS cell_row, 'text' AS cell_column, i + 1 AS part, length(substr(text, i * 14000 + 1, 14000)) AS chars, sha256(substr(text, i * 14000 + 1, 14000)) AS value_sha256 FROM s
"""


def e6_workbook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exports.numbered(_t(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    return exports.workbook_parts(rows, 300)


def e6_part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.part_ranges({t: _t(spark, sf_dir, t) for t in ("documents", "conversations", "labels", "benchmark")}, 300)


_E6 = """
WITH c(t, n) AS (SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark),
p AS (SELECT unnest(generate_series(1, (SELECT greatest(1, max((n + 299) // 300)) FROM c))) AS part)
SELECT t AS table_name, part, CASE WHEN (part - 1) * 300 < n THEN (part - 1) * 300 + 1 END AS first_row, CASE WHEN (part - 1) * 300 < n THEN least(n, part * 300) END AS last_row FROM c, p
"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").otherwise("Unsure")
    return _t(spark, sf_dir, "labels").select("doc_id", label.alias("label"), F.when(F.col("toxic") == 1, "pending_review").otherwise("reviewed").alias("status"))


def e8_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("doc_id", exports.disposition(F.col("label"), F.col("status")).alias("disposition"))


def o3_annotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reviewed(spark, sf_dir)
    return exports.numbered(r, [*exports.annotation_rank(F.col("label"), F.col("status")), F.col("doc_id")], "place").select("doc_id", "place")


def a20_joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.joined_values(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


def c9_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    out = review.screen(d, {"placeholder": F.col("text").isin("[deleted]", "[removed]", ""), "short": F.length("text") < 200}, {"no_text": F.col("text").isNull(), "few_words": F.length("text") < 50})
    return out.select("doc_id", "decision", F.concat_ws(",", "reasons").alias("reasons"))


_C9 = """
SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 50 THEN 'pending' WHEN text IN ('[deleted]', '[removed]', '') OR length(text) < 200 THEN 'excluded' ELSE 'retained' END AS decision,
  concat_ws(',', CASE WHEN text IS NULL THEN 'no_text' END, CASE WHEN length(text) < 50 THEN 'few_words' END, CASE WHEN text IN ('[deleted]', '[removed]', '') THEN 'placeholder' END, CASE WHEN length(text) < 200 THEN 'short' END) AS reasons FROM documents
"""


def c11_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels split by the source of their document as group; toxic stands for predicted, low quality for actual."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL")
    split = review.split_of(F.col("source"), "s1", {"train": 50, "validation": 25, "test": 25})
    return review.evaluation(rows.select(split.alias("split"), (F.col("toxic") == 1).alias("predicted"), (F.col("quality") == 0).alias("actual")))


_C11 = """
WITH r AS (SELECT CAST('0x' || substr(sha256('s1:' || source), 1, 8) AS BIGINT) % 100 AS h, toxic = 1 AS p, quality = 0 AS a FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
c AS (SELECT CASE WHEN h < 50 THEN 'train' WHEN h < 75 THEN 'validation' ELSE 'test' END AS split, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM r GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall,
  CASE WHEN tp + fn = 0 THEN 'no_positive_labels' WHEN tp + fp = 0 THEN 'no_positive_predictions' END AS reason FROM c
"""


def c12_final_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as human decisions, toxic ones as the model's."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    l = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), "quality", F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("label"))  # noqa: E741
    views = l.where("label = 'No'").select("record_id", F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("decision"), F.lit("decided").alias("state"))
    return review.final_views(d, views, l)


_C12 = """
SELECT d.doc_id AS record_id, CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 'pending' WHEN quality = 1 THEN 'included' ELSE 'excluded' END AS "view",
  CASE WHEN l.doc_id IS NULL THEN 'not_reviewed' WHEN toxic = 1 THEN 'model_label_only' ELSE 'human_decision' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def c13_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.audit_sample(_t(spark, sf_dir, "documents"), "doc_id", "source", 5, "audit")


_C13 = """
SELECT source, doc_id, round(least(1.0, 5 / n), 9) AS inclusion_probability FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY sha256('audit:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5
"""


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("bytes"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("rows"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") / 4).alias("seconds"))


def a12_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.estimate(_shards(spark, sf_dir))


_A12 = """
SELECT o_orderpriority AS kind, CAST(sum(o_orderkey) FILTER (f) AS BIGINT) AS "rows", round(sum(o_custkey / 4) FILTER (f), 6) AS seconds, round(sum(o_orderkey) FILTER (f) / greatest(sum(o_custkey / 4) FILTER (f), 0.001), 4) AS rows_per_second,
  round(sum(o_custkey / 4) FILTER (f) * sum(o_custkey) / greatest(sum(o_custkey) FILTER (f), 1), 4) AS estimate, round(sum(o_custkey / 4) FILTER (f) * sum(o_custkey) / greatest(sum(o_custkey) FILTER (f), 1) * 0.5, 4) AS low,
  round(sum(o_custkey / 4) FILTER (f) * sum(o_custkey) / greatest(sum(o_custkey) FILTER (f), 1) * 2, 4) AS high FROM (SELECT *, o_orderstatus = 'F' AS f FROM orders) GROUP BY o_orderpriority
"""


def _checkpoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    key = lambda scope: recovery.shard_key("rev1", F.col("path"), F.lit(None).cast("string"), scope, "1", "full")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("complete").alias("status"), F.col("o_orderkey").alias("scanned"), (F.col("o_orderpriority") == "1-URGENT").alias("filtered"), F.lit(False).alias("targeted"))
    return o.withColumn("key", key("a")), key


def d6_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = _checkpoints(spark, sf_dir)
    return recovery.compatible(c, key, "a", "b").drop("status")


_D6 = """
SELECT sha256('["rev1", "' || o_custkey || '", "", "b", "1", "full"]') AS key, CAST(o_custkey AS VARCHAR) AS path, max(o_orderkey) AS scanned FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' GROUP BY o_custkey
"""


def c7_scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = _checkpoints(spark, sf_dir)
    shards = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path")).withColumn("key", key("a"))
    return recovery.scan_plan(shards, c).drop("key")


_C7 = """
WITH d AS (SELECT o_custkey, bool_or(o_orderstatus <> 'P') AS c FROM orders GROUP BY o_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c THEN 'reuse' ELSE 'scan' END AS action, CASE WHEN c THEN 'complete_under_same_key' WHEN c IS NOT NULL THEN 'partial_restarts' ELSE 'no_checkpoint' END AS reason FROM customer LEFT JOIN d ON c_custkey = o_custkey
"""

QUERIES = {
    f.__name__: f
    for f in (
        g6_components, g7_originals, g10_coverage, g12_incident_ids, p9_canonical, s5_select_files, v2_violations, v3_span_violations, v7_segments, w6_batches, v10_precedence, e5_text_parts, e6_workbook_parts, e6_part_ranges,
        e8_dispositions, o3_annotation_order, a20_joined_values, c7_scan_plan, c9_screening, c11_evaluation, c12_final_views, c13_audit_sample, a12_estimate, d6_compatible,
    )
}
ORACLE = {
    "g6_components": _G6, "g7_originals": _G7, "g10_coverage": _G10, "v2_violations": _V2, "v3_span_violations": _V3, "v7_segments": _V7, "w6_batches": _W6, "v10_precedence": _V10, "e5_text_parts": _E5, "e6_part_ranges": _E6,
    "c7_scan_plan": _C7, "c9_screening": _C9, "c11_evaluation": _C11, "c12_final_views": _C12, "c13_audit_sample": _C13, "a12_estimate": _A12, "d6_compatible": _D6,
    "g12_incident_ids": """SELECT doc_id, 'i_' || substr(sha256('["rev1", "t3_' || doc_id || '"]'), 1, 20) AS incident_id FROM documents""",
    "p9_canonical": f"SELECT 't1_' || conv_id || 'x' || turn AS typed_id, 't3_' || conv_id AS thread_id, 't3_' || conv_id AS parent_id, '{SITE}/comments/' || conv_id || '/_/' || conv_id || 'x' || turn || '/' AS canonical_permalink FROM conversations",
    "s5_select_files": "SELECT CAST(o_orderkey AS VARCHAR) AS path, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderstatus = 'O' THEN 'submissions' ELSE 'comments' END AS kind FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-01' AND '1996-06'",
    "e6_workbook_parts": "SELECT conv_id, turn, rn AS row_number, CAST((rn - 1) // 300 AS BIGINT) + 1 AS part FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations)",
    "e8_dispositions": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Pending review' WHEN quality = 1 THEN 'Reported event' WHEN quality = 0 THEN 'Reviewed No' ELSE 'Reviewed Unsure' END AS disposition FROM labels",
    "o3_annotation_order": "SELECT doc_id, row_number() OVER (ORDER BY coalesce(toxic = 1, false), CASE quality WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, doc_id) AS place FROM labels",
    "a20_joined_values": """SELECT user_id, string_agg(event_type, '; ' ORDER BY o) AS "values" FROM (SELECT user_id, event_type, min(event_id) AS o FROM events WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY user_id""",
}
