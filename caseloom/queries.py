"""Registered queries of the engine's own operators and their SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.operators import cases, matcher, state
from caseloom.plans import assembly, bundling, catalog, details, ledger, relations, reviewing, sourcing

#: the tables that these queries read
TABLES = ("documents", "conversations", "benchmark", "labels", "pages", "events", "orders", "lineitem", "customer")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def t5_find_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), tx.normalize_column(F.col("text")).alias("normalized"))
    hits = matcher.find_phrases(_t(spark, sf_dir, "documents"), phrases, "doc_id", ["text"])
    return hits.select("doc_id", F.col("query_id").cast("long").alias("item_id"), F.col("norm_start").cast("long").alias("norm_start"))


_NORM = r"trim(regexp_replace(replace(translate(lower(text), '’‘ʼ＇', ''''''''''), 'ß', 'ss'), '\s+', ' ', 'g'))"
_NORM = "regexp_replace(" * 6 + _NORM + "".join(rf", '\b{a}\b', '{b}', 'g')" for a, b in tx.SPELLINGS.items())
_T5 = rf"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents), p AS (SELECT item_id, {_NORM} AS p FROM benchmark),
m AS (SELECT doc_id, item_id, t, p, unnest(generate_series(1, length(t) - length(p) + 1)) AS s FROM d JOIN p ON contains(t, p) WHERE length(p) > 0)
SELECT doc_id, item_id, CAST(s - 1 AS BIGINT) AS norm_start FROM m
WHERE substr(t, s, length(p)) = p
  AND NOT (s > 1 AND regexp_matches(substr(t, s - 1, 1), '[\pL\pN]') AND regexp_matches(substr(p, 1, 1), '[\pL\pN]'))
  AND NOT (s + length(p) <= length(t) AND regexp_matches(substr(t, s + length(p), 1), '[\pL\pN]') AND regexp_matches(substr(p, length(p), 1), '[\pL\pN]'))
"""


def f5_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tx.normalize_column(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("norm_chars"), F.sha2(n, 256).alias("norm_sha256"))


def f1_typed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.typed_id(F.col("doc_id")).alias("typed_id"), tx.typed_id(F.concat(F.lit(" T1_"), "doc_id", F.lit(" "))).alias("comment_id"), tx.typed_id(F.concat(F.lit("x9_"), "doc_id")).alias("bad_id"))


def f8_triage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.triage_flags(F.col("text")), ",").alias("flags"))


def f11_sheet_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "=", " +", "-", "@")]), (F.col("doc_id") % 5 + 1).cast("int")), "text")
    return _t(spark, sf_dir, "documents").select("doc_id", tx.sheet_literal(cell).alias("cell"))


def f13_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.posexplode(tx.text_parts(F.col("text"), 14000)).alias("part", "value")
    return _t(spark, sf_dir, "documents").select("doc_id", parts).select("doc_id", F.col("part").cast("long").alias("part"), F.length("value").cast("long").alias("chars"), F.sha2("value", 256).alias("part_sha256"))


def f14_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.utf16_units(F.col("text")).alias("units")).where("units > 30000")


def a9_prior_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh user's events come from a deleted author, every fiftieth event has no time, every ninetieth no kind."""
    ev = _t(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 7 == 0, "[deleted]").otherwise(F.col("user_id").cast("string")).alias("author"), F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("ts"),
        F.when(F.col("event_id") % 90 > 0, F.col("event_type")).alias("event_type"),
    )
    return cases.prior_activity(ev, "author", "ts", {"prior_clicks": "click", "prior_views": "view"}, "event_type").drop("ts", "event_type")


_A9 = """
WITH e AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN '[deleted]' ELSE user_id::VARCHAR END AS author, CASE WHEN event_id % 50 > 0 THEN ts END AS t, CASE WHEN event_id % 90 > 0 THEN event_type END AS kind FROM events),
j AS (
  SELECT a.event_id, a.author, a.kind, count(*) FILTER (b.kind = 'click') AS clicks, count(*) FILTER (b.kind = 'view') AS views,
    count(DISTINCT b.kind) + max(CASE WHEN b.event_id IS NOT NULL AND b.kind IS NULL THEN 1 ELSE 0 END) AS kinds, coalesce(bool_or(b.kind = a.kind), false) AS again
  FROM e a LEFT JOIN e b ON b.author = a.author AND a.author <> '[deleted]' AND b.t < a.t GROUP BY ALL
)
SELECT event_id, author, CASE WHEN author <> '[deleted]' THEN clicks END AS prior_clicks, CASE WHEN author <> '[deleted]' THEN views END AS prior_views,
  CASE WHEN author <> '[deleted]' AND kind IS NOT NULL THEN CAST(kinds + CASE WHEN again THEN 0 ELSE 1 END AS BIGINT) END AS kinds_so_far FROM j
"""
_HREF = r'href="/([A-Za-z0-9]+)"'


def g1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select(
        F.concat(F.lit("t3_"), "page_id").alias("typed_id"), F.concat(F.lit("t3_"), "page_id").alias("thread_id"), F.lit("submissions").alias("kind"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("original_author"), "html"
    )
    links = cases.extract_links(p, "html", _HREF, (1,))
    return links.groupBy("source_thread", "target_thread").agg(F.count("*").alias("n"), F.sum(F.length("url")).alias("url_chars"))


def g2_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.exact_copies(_t(spark, sf_dir, "documents"), "doc_id", "text")


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    thread = F.concat(F.lit("t3_"), "conv_id")
    return c.select(
        F.when(F.col("turn") == 0, thread).otherwise(F.concat(F.lit("t1_"), "conv_id", F.lit("x"), "turn")).alias("typed_id"), thread.alias("thread_id"),
        F.when(F.col("turn") == 0, "submissions").otherwise("comments").alias("kind"), F.col("role").alias("author"), "text",
    )


def g3_group_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _threads(spark, sf_dir)
    return cases.group_seeds(r.where(F.contains("text", F.lit(" the "))), r).select("seed_key", F.array_join("members", ",").alias("members"))


_G3 = """
WITH r AS (SELECT CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || 'x' || turn END AS typed_id, 't3_' || conv_id AS thread_id,
  turn = 0 AS post, role AS author, text FROM conversations)
SELECT CASE WHEN r.post OR r.author = p.author THEN r.thread_id ELSE r.typed_id END AS seed_key, string_agg(DISTINCT r.typed_id, ',' ORDER BY r.typed_id) AS members
FROM r LEFT JOIN r p ON p.post AND p.typed_id = r.thread_id WHERE contains(r.text, ' the ') GROUP BY 1
"""


def d1_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "last")


def d1_upsert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "first")


def d5_resume_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", state.resume_key(F.lit("rev1"), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


def c2_current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("record_id"), (F.col("user_id") % 3).alias("decision_type"), F.col("event_type").alias("decision"), F.when(F.col("event_id") % 100 != 0, F.col("event_id") - 1).alias("supersedes_event_id"))
    return state.current_view(e)


_C2 = """
WITH h AS (SELECT * FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 100 <> 0 AND b.event_id - 1 = a.event_id))
SELECT user_id AS record_id, user_id % 3 AS decision_type, CASE WHEN count(*) = 1 THEN min(event_type) END AS decision,
  CASE WHEN count(*) = 1 THEN 'decided' ELSE 'pending' END AS state FROM h GROUP BY user_id
"""

_OWN = (t5_find_phrases, f5_normalize, f1_typed_ids, f8_triage_flags, f11_sheet_literal, f13_text_parts, f14_overlong, a9_prior_activity, g1_links, g2_exact_copies, g3_group_seeds, d1_upsert_last, d1_upsert_first, d5_resume_keys, c2_current_view)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OWN} | catalog.QUERIES | relations.QUERIES | assembly.QUERIES | bundling.QUERIES | reviewing.QUERIES | ledger.QUERIES | details.QUERIES | sourcing.QUERIES
_DOUBT = " OR ".join(f"contains(lower(text), '{w}')" for w in ("if ", "might ", "would ", "hope ", "afraid", "worried", "in case", "don''t want", "didn''t", "did not"))
_SHOWN = " OR ".join(f"contains(lower(text), '{w}')" for w in ("showed ", "told ", "gave "))
ORACLE: dict[str, str] = {
    "t5_find_phrases": _T5,
    "f5_normalize": f"SELECT doc_id, length({_NORM}) AS norm_chars, sha256({_NORM}) AS norm_sha256 FROM documents",
    "f1_typed_ids": "SELECT doc_id, 't3_' || doc_id AS typed_id, 't1_' || doc_id AS comment_id, CAST(NULL AS VARCHAR) AS bad_id FROM documents",
    "f8_triage_flags": f"SELECT doc_id, concat_ws(',', CASE WHEN {_DOUBT} THEN 'negation_or_hypothetical_language' END, CASE WHEN contains(text, '>') OR contains(text, '\"') THEN 'possible_quotation' END, CASE WHEN {_SHOWN} THEN 'possible_voluntary_sharing' END) AS flags FROM documents",
    "f11_sheet_literal": r"SELECT doc_id, CASE WHEN regexp_matches(c, '^\s*[=+\-@]') THEN '''' || c ELSE c END AS cell FROM (SELECT doc_id, (['', '=', ' +', '-', '@'])[doc_id % 5 + 1] || text AS c FROM documents)",
    "f13_text_parts": "SELECT doc_id, part, length(v) AS chars, sha256(v) AS part_sha256 FROM (SELECT doc_id, part, substr(text, part * 14000 + 1, 14000) AS v FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / 14000) AS BIGINT), 1) - 1)) AS part FROM documents))",
    "f14_overlong": "SELECT doc_id, length(text) AS units FROM documents WHERE length(text) > 30000",
    "a9_prior_activity": _A9,
    "g1_links": f"SELECT 't3_' || page_id AS source_thread, 't3_' || lower(x) AS target_thread, count(*) AS n, CAST(sum(length(x) + 8) AS BIGINT) AS url_chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS x FROM pages) WHERE lower(x) <> CAST(page_id AS VARCHAR) GROUP BY ALL",
    "g2_exact_copies": "WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents WHERE length(trim(text, ' ')) >= 100), f AS (SELECT t, min(doc_id) AS post_id FROM t GROUP BY t) SELECT post_id, doc_id AS copy_id FROM t JOIN f USING (t) WHERE doc_id <> post_id",
    "g3_group_seeds": _G3,
    "d1_upsert_last": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "d1_upsert_first": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "d5_resume_keys": """SELECT o_orderkey, sha256('["rev1", "' || o_orderkey || '", "' || o_orderstatus || '", "' || o_orderpriority || '"]') AS key FROM orders""",
    "c2_current_view": _C2,
} | catalog.ORACLE | relations.ORACLE | assembly.ORACLE | bundling.ORACLE | reviewing.ORACLE | ledger.ORACLE | details.ORACLE | sourcing.ORACLE
