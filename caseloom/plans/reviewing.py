"""Registered queries of review decisions: contract faults, conversion and the review table, over the driver's tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import annotations, contracts, conversion, review_table
from caseloom.plans.catalog import _t
from caseloom.plans.scratch import written


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


def _decision(k, quote):
    """A decision about document k that quotes `quote`; k tells what it says and where it goes wrong."""
    struct = lambda **c: F.struct(*[(x if hasattr(x, "alias") else F.lit(x)).alias(n) for n, x in c.items()])
    record, strings, longs = F.concat(F.lit("t3_"), k), F.array().cast("array<string>"), F.array().cast("array<bigint>")
    null = lambda t: F.lit(None).cast(t)
    supports = F.when(k % 5 == 0, F.array(F.lit("qualification"), F.lit("outcomes"))).when(k % 5 == 1, F.array(F.lit("intent"))).otherwise(F.array(*[F.lit(g) for g in contracts.GROUPS]))
    evidence = struct(record_id=record, field="selftext", quote=quote, supports=supports, content_type="Unclear", role_relative_to_original_op="OP", attribution="author's own statement", event_time_expression=null("string"))
    outcome = struct(label="Break-up", affected_person=null("string"), timing="later", attributed_to_reidentification=True, evidence_indexes=F.array(F.when(k % 11 == 3, 1).otherwise(0).cast("bigint")))
    return struct(
        incident_id=F.concat(F.lit("i_"), k), reviewed_record_ids=F.when(k % 13 == 0, strings).otherwise(F.array(record)), label=F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("Unsure"), rationale="read", earlier_original_missing=k % 17 == 0,
        intent=F.when(k % 2 == 0, "Unclear").otherwise("Social networking"), secondary_intents=strings, evidence=F.when(k % 19 == 0, F.array().cast(f"array<{contracts.DECISION['evidence'].dataType.elementType.simpleString()}>")).otherwise(F.array(evidence)),
        evidence_basis=F.array(F.lit("unclear")), identity_connection_type=F.array(F.lit("unclear")), voluntary_disclosure=null("boolean"), reporters=F.array(F.lit("OP/author")), finders=F.array(F.lit("Unclear")), relationship="Unclear", relationship_subtypes=F.array(F.lit("unclear")),
        target_is_containing_thread_op=null("boolean"), discovery_paths=F.when(k % 7 == 0, F.array(F.lit("Browsing Reddit"), F.lit("Other"))).otherwise(strings), discovery_platforms=F.array(F.lit("phone"), F.lit("web")), found_time_expression=null("string"), discovery_notes=null("string"),
        series_status="Unclear", series_supported_total=null("bigint"), series_count_prior_to_reidentification=null("bigint"), series_basis=null("string"), account_type="Unclear", declared_throwaway=null("boolean"), declared_one_time_use=null("boolean"), observed_account_reuse=null("boolean"),
        outcomes=F.when(k % 4 == 0, F.array(outcome)).otherwise(F.array().cast(f"array<{contracts.DECISION['outcomes'].dataType.elementType.simpleString()}>")), no_outcome_reported=null("boolean"), explicitly_no_repercussions=null("boolean"),
        preservation=F.when(k % 6 == 0, F.array(struct(post_id=record, type="another subreddit", source_record_id=null("string"), source_url="u", completeness="full", evidence_indexes=F.array(F.lit(0).cast("bigint"))))).otherwise(F.array(struct(post_id=record, type="unknown", source_record_id=null("string"), source_url=null("string"), completeness="unknown", evidence_indexes=longs))),
        additional_incident_notes=F.when(k % 23 == 0, F.array(F.lit("another"))).otherwise(strings),
    )


def _texts(spark, sf_dir):
    """Decisions as JSON texts, one in eight of each kind of fault."""
    k = F.col("doc_id")
    quote = F.when(k % 29 == 0, "not in the text 😀").otherwise(F.substring("text", 1, 20))
    j = F.to_json(_decision(k, quote), {"ignoreNullFields": "false"})
    swap = lambda a, b: F.replace(j, F.lit(a), F.lit(b))
    m = k % 64
    bad = (
        F.when(m == 1, swap('"rationale":"read"', '"rationale":"read","extra":{"a":1}')).when(m == 2, swap('"rationale":"read",', "")).when(m == 3, F.regexp_replace(j, '"label":"[A-Za-z]+"', '"label":"Maybe"')).when(m == 4, swap('"field":"selftext"', '"field":"url","more":null'))
        .when(m == 5, swap('"rationale":"read"', '"rationale":null')).when(m == 6, swap('"discovery_platforms":["phone","web"]', '"discovery_platforms":["phone",7]')).when(m == 7, F.substring(j, F.lit(1), F.length(j) - 1)).otherwise(j)
    )
    return _docs(spark, sf_dir).select("doc_id", bad.alias("json"))


def v15_decision_faults(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.explode(contracts.faults(F.col("json"), contracts.DECISION)).alias("x")).select("doc_id", "x.*")


_V15 = """
WITH d AS (SELECT doc_id, doc_id % 64 AS m, doc_id % 19 <> 0 AS quoted FROM documents)
SELECT doc_id, 'extra' AS path, 'unknown_key' AS fault FROM d WHERE m = 1 UNION ALL SELECT doc_id, 'rationale', 'missing_key' FROM d WHERE m = 2 UNION ALL SELECT doc_id, 'label', 'not_allowed' FROM d WHERE m = 3
UNION ALL SELECT doc_id, 'evidence[0].more', 'unknown_key' FROM d WHERE m = 4 AND quoted UNION ALL SELECT doc_id, 'evidence[0].field', 'not_allowed' FROM d WHERE m = 4 AND quoted
UNION ALL SELECT doc_id, 'rationale', 'null' FROM d WHERE m = 5 UNION ALL SELECT doc_id, 'discovery_platforms[1]', 'wrong_type' FROM d WHERE m = 6 UNION ALL SELECT doc_id, '', 'not_json' FROM d WHERE m = 7
"""


def _ready(spark, sf_dir):
    """Whole decisions only, read from their texts, beside the documents as bundles of one post."""
    j = written(_texts(spark, sf_dir), "decisions").where("doc_id % 64 = 0 OR doc_id % 64 > 7")
    decisions = j.select(F.concat(F.lit("i_"), "doc_id").alias("incident_id"), contracts.typed(F.col("json"), contracts.DECISION).alias("d"))
    docs, record = _docs(spark, sf_dir), F.concat(F.lit("t3_"), "doc_id")
    texts = docs.select(record.alias("record_id"), F.lit("selftext").alias("field"), "text", record.alias("thread_id"), F.col("source").alias("author"), F.col("doc_id").alias("created_utc"), F.lit(None).cast("long").alias("edit_timestamp"), F.lit(None).cast("string").alias("permalink"))
    post = {"post_id": record, "subreddit": F.col("source"), "full_text": F.col("text"), "created_utc": F.col("doc_id"), "archive_text_availability": F.when(F.col("text") == "", "empty").otherwise("text")}
    bundles = docs.where("doc_id % 31 > 0").select(
        F.concat(F.lit("i_"), "doc_id").alias("incident_id"), F.array(record).alias("record_ids"), F.array(record).alias("seed_record_ids"), conversion.post_struct(F.lit(True), post).alias("original"), record.alias("original_post_id"),
        F.lit("provisional seed thread").alias("original_resolution_status"), F.array(record).alias("observed_post_ids"), F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 4).alias("retrieved_comments"), F.lit(None).cast("string").alias("comments_missing_reason"),
    )
    return conversion.prepared(decisions, bundles, texts), docs


def v8_conversion_problems(spark, sf_dir):
    return conversion.conversion_problems(_ready(spark, sf_dir)[0])


# what a decision claims (c_), and what its evidence supports (s_): qualification q, intent i, outcomes o, preservation p, all others a
_D = """d AS (
  SELECT doc_id AS k, 'i_' || doc_id AS incident_id, coalesce(text, '') AS text, source, doc_id % 19 > 0 AS e, CASE WHEN doc_id % 29 = 0 THEN 'not in the text 😀' ELSE substr(coalesce(text, ''), 1, 20) END AS quote FROM documents WHERE doc_id % 64 = 0 OR doc_id % 64 > 7
), s AS (SELECT *, e AND k % 5 <> 1 AS q, e AND k % 5 > 0 AS i, e AND k % 5 <> 1 AS o, e AND k % 5 > 1 AS a, k % 31 > 0 AS known FROM d),
x AS (SELECT *, list_filter([
  CASE WHEN NOT known THEN 'unknown_incident' END, CASE WHEN known AND k % 13 = 0 THEN 'records_not_covered' END, CASE WHEN e AND (quote = '' OR NOT contains(text, quote) OR k % 13 = 0) THEN 'quote_not_exact' END,
  CASE WHEN k % 3 = 0 AND NOT q THEN 'unsupported: qualification' END, CASE WHEN k % 2 = 1 AND NOT i THEN 'unsupported: intent' END, CASE WHEN NOT a AND NOT (e AND known) THEN 'unsupported: actors' END,
  CASE WHEN k % 7 = 0 AND NOT a THEN 'unsupported: discovery' END, CASE WHEN k % 4 = 0 AND NOT o THEN 'unsupported: outcomes' END, CASE WHEN k % 6 = 0 AND NOT a THEN 'unsupported: preservation' END,
  CASE WHEN k % 4 = 0 AND (k % 11 = 3 OR NOT o) THEN 'evidence of outcomes' END, CASE WHEN k % 6 = 0 AND NOT a THEN 'evidence of preservation' END, CASE WHEN k % 17 = 0 AND k % 2 = 1 THEN 'intent_of_missing_original' END
], lambda p: p IS NOT NULL) AS problems FROM s)"""
_V8P = f"WITH {_D} SELECT incident_id, unnest(problems) AS problem FROM x"


def v8_converted(spark, sf_dir):
    """Each converted annotation with what the later checks find in it."""
    a = written(conversion.converted(_ready(spark, sf_dir)[0], "review"), "annotations")
    bad = conversion.contract_faults(a).groupBy("incident_id").agg(F.count("*").alias("faults"))
    lost = conversion.dangling_refs(a).groupBy("incident_id").agg(F.count("*").alias("dangling"))
    e = F.element_at("evidence", 1)
    return a.join(bad, "incident_id", "left").join(lost, "incident_id", "left").select(
        "incident_id", "confirmed_reidentification", "original_resolution_status", F.col("original.post_id").alias("post_id"), F.col("original.primary_intent").alias("intent"), F.size("evidence").cast("long").alias("evidence"), e["quote"].alias("quote"), e["raw_start"].alias("raw_start"), e["raw_end"].alias("raw_end"),
        e["reporting_username"].alias("reporter"), F.array_join(F.array_sort(F.map_keys("claim_evidence")), ",").alias("claims"), F.size("discovery.chain").cast("long").alias("steps"), F.size("outcomes").cast("long").alias("outcomes"), F.array_join(F.flatten(F.transform("outcomes", lambda o: o["evidence_refs"])), ",").alias("outcome_refs"),
        F.size("additional_incidents").cast("long").alias("notes"), F.size("missingness").cast("long").alias("reasons"), F.coalesce("faults", F.lit(0)).alias("faults"), F.coalesce("dangling", F.lit(0)).alias("dangling"),
    )


_V8C = f"""WITH {_D}, c AS (SELECT *, k % 17 = 0 AS lost FROM x WHERE len(problems) = 0)
SELECT incident_id, CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unsure' END AS confirmed_reidentification, CASE WHEN lost THEN 'unresolved' ELSE 'provisional seed thread' END AS original_resolution_status,
  CASE WHEN NOT lost THEN 't3_' || k END AS post_id, CASE WHEN k % 2 = 0 THEN 'Unclear' ELSE 'Social networking' END AS intent, CAST(e AS BIGINT) AS evidence, CASE WHEN e THEN quote END AS quote, CASE WHEN e THEN CAST(0 AS BIGINT) END AS raw_start, CASE WHEN e THEN length(quote) END AS raw_end,
  CASE WHEN e THEN source END AS reporter, CASE WHEN NOT e THEN '' WHEN k % 5 = 0 THEN 'actors,outcomes,qualification' WHEN k % 5 = 1 THEN 'actors,intent' ELSE 'account,actors,discovery,intent,outcomes,preservation,qualification,series' END AS claims,
  CAST(CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS steps, CAST(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS outcomes, CASE WHEN k % 4 = 0 THEN 'e1' ELSE '' END AS outcome_refs, CAST(CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS notes,
  CAST(CASE WHEN lost THEN 17 ELSE 16 END AS BIGINT) AS reasons, CAST(0 AS BIGINT) AS faults, CAST(0 AS BIGINT) AS dangling FROM c"""


def _e1(spark, sf_dir):
    """The converted annotations, each with a second seed that every third document lacks, as a table of all columns."""
    ready, docs = _ready(spark, sf_dir)
    k = F.col("doc_id")
    records = docs.where(k % 10 != 5).select(
        F.concat(F.lit("t3_"), k).alias("typed_id"), k.cast("string").alias("id"), F.lit(None).cast("string").alias("canonical_permalink"), F.concat(F.lit("T "), k).alias("title"), F.col("source").alias("subreddit"), F.array(F.lit("flag")).alias("triage_flags"), (k % 7).alias("num_comments"),
        F.concat(F.lit("u/"), k).alias("url"), F.col("source").alias("author"), (k % 9).alias("score"), F.lit(None).cast("double").alias("upvote_ratio"), F.lit(None).cast("string").alias("link_flair_text"), F.lit(None).cast("boolean").alias("is_self"), (k % 2 == 0).alias("over_18"),
    )
    a = conversion.converted(ready, "review")
    a = written(a.withColumn("seed_record_ids", F.array_append("seed_record_ids", F.concat(F.lit("t3_"), F.substring("incident_id", 3, 20).cast("long") + 1))), "annotations")
    edits = docs.where(k % 8 == 1).select(F.concat(F.lit("i_"), k).alias("incident_id"), F.lit("No").alias("label"), F.lit("seen").alias("notes"))
    return a, review_table.review_table(a, records, edits)


HEADERS = [h for h, _ in review_table.COLUMNS]


def e1_review_table(spark, sf_dir):
    """Every cell of the review table but the whole annotation's."""
    return review_table.unpivoted(_e1(spark, sf_dir)[1], [h for h in HEADERS if h != "Full annotation JSON"]).withColumn("value", F.when(F.length("value") > 64, F.sha2("value", 256)).otherwise(F.col("value")))


def e2_incidents(spark, sf_dir):
    a, table = _e1(spark, sf_dir)
    return review_table.incident_table(table, a).select("incident_id", "seed_record_id", "title", F.col("Reviewer label").alias("reviewer_label"), F.col("All seed record IDs").alias("seeds"))


_N = "NULL"
_CELLS = [
    "r.id", _N, "r.title", _N, _N, _N, _N, _N, "'Unclear'", "'Unknown'", _N, _N, _N, "p.comments", _N, "'Unknown'", "intent", "p.url", "post", "CASE WHEN NOT lost THEN strftime(to_timestamp(k) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') END",
    "CASE WHEN NOT lost THEN c.source END", _N, "CASE WHEN lost THEN '' ELSE substr(text, 1, 14000) END", "CASE WHEN NOT lost AND length(text) > 14000 THEN substr(text, 14001, 14000) END", "CASE WHEN e THEN quote ELSE '' END", "'OP/author'", _N,
    "CASE WHEN k % 7 = 0 THEN 'Browsing Reddit: phone, web; Other: phone, web' ELSE '' END", "'Unclear'", _N, "'Unclear; supported total: unknown; pre-discovery: unknown'", "CASE WHEN k % 4 = 0 THEN 'Break-up' ELSE 'Unclear' END",
    "CASE WHEN k % 6 = 0 THEN 'another subreddit: u' ELSE 'unknown' END", "p.source", "p.score", _N, "p.comments", "CASE WHEN NOT lost THEN k::VARCHAR END", _N, _N, "p.over", "CASE WHEN lost THEN '' ELSE text END",
    "label", f"'{conversion.REVIEWED}'", "incident_id", "CASE WHEN lost THEN 'unresolved' ELSE 'provisional seed thread' END", """CASE WHEN e THEN '["Unclear"]' ELSE '[]' END""", "'Unclear'", _N, """'["unclear"]'""", """CASE WHEN e THEN '["e1"]' ELSE '[]' END""", _N, _N, "missing",
    "'{\"retrieved_comments\":' || k % 4 || ',\"comments_missing_reason\":null}'", "'{\"classification_performed\":true,\"all_retrieved_text_reviewed\":true,\"record_ids\":[\"t3_' || k || '\"],\"all_thread_comments_available\":false,\"scope\":\"" + conversion.SCOPE + "\",\"independent_verification\":false}'",
    """'["unclear"]'""", _N, "'cases/' || incident_id || '.json'", "'annotations/' || incident_id || '.json'", """CASE WHEN r.id IS NOT NULL THEN '["flag"]' END""", "CASE WHEN label = 'Yes' THEN 'Reported event' ELSE 'Reviewed ' || label END",
    "CASE WHEN k % 8 = 1 THEN 'No' END", "CASE WHEN k % 8 = 1 THEN 'seen' END",
    "'read'", f"CASE WHEN intent = 'Unclear' THEN '{review_table.INTENT_DEFINITIONS['Unclear']}' ELSE '{review_table.INTENT_DEFINITIONS['Social networking']}' END", "r.source", f"'{conversion.STATUS_BASIS}'", "CASE WHEN lost THEN 'missing' WHEN text = '' THEN 'empty' ELSE 'text' END",
    "CASE WHEN e THEN c.source ELSE '' END", "CASE WHEN e THEN strftime(to_timestamp(k) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') ELSE '' END", "CASE WHEN e THEN 'selftext' ELSE '' END", "CASE WHEN e THEN 'OP' ELSE '' END", "'Unclear'", _N, _N, "'1'",
    "CASE WHEN k % 4 = 0 THEN 'Break-up' ELSE '' END", "CASE WHEN k % 6 = 0 THEN 'another subreddit' ELSE 'unknown' END", "CASE WHEN k % 6 = 0 THEN 'u' ELSE '' END", "(k % 4)::VARCHAR", "'false'", _N, "'review'",
]
_REASONS = {**annotations.PENDING_REASONS, **{x: conversion.UNSUPPORTED for x in ("classification", "actors", "discovery", "outcomes", "post_intent")}, "comments": conversion.NO_COMMENTS}
_MISSING = "{" + ",".join(f'"{x}":"{y}"' for x, y in _REASONS.items())
_E1 = f"""WITH {_D}, c AS (
  SELECT *, k % 17 = 0 AS lost, CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unsure' END AS label, CASE WHEN k % 2 = 0 THEN 'Unclear' ELSE 'Social networking' END AS intent, CASE WHEN k % 17 > 0 THEN 't3_' || k END AS post,
    '{_MISSING}' || CASE WHEN k % 17 = 0 THEN ',"original_post":"{conversion.LOST_ORIGINAL}"' ELSE '' END || '}}' AS missing FROM x WHERE len(problems) = 0
), r AS (SELECT doc_id, doc_id::VARCHAR AS id, 'T ' || doc_id AS title, source, (doc_id % 7)::VARCHAR AS comments, 'u/' || doc_id AS url, (doc_id % 9)::VARCHAR AS score, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS over FROM documents WHERE doc_id % 10 <> 5),
t AS (
  SELECT c.incident_id, 't3_' || (k + s.place) AS seed_record_id, s.place, unnest([{", ".join(f"{{'h': '{h.replace(chr(39), chr(39) * 2)}', 'v': ({v})::VARCHAR}}" for h, v in zip([h for h in HEADERS if h != "Full annotation JSON"], _CELLS, strict=True))}]) AS cell
  FROM c, (VALUES (0), (1)) s(place) LEFT JOIN r ON r.doc_id = k + s.place LEFT JOIN r p ON NOT lost AND p.doc_id = k
)
SELECT incident_id, seed_record_id, place, cell.h AS header, CASE WHEN length(cell.v) > 64 THEN sha256(cell.v) ELSE cell.v END AS value FROM t"""
_E2 = f"""WITH {_D} SELECT incident_id, 't3_' || (k + 1) AS seed_record_id, CASE WHEN EXISTS (SELECT 1 FROM documents r WHERE r.doc_id = k + 1 AND r.doc_id % 10 <> 5) THEN 'T ' || (k + 1) END AS title,
  CASE WHEN k % 8 = 1 THEN 'No' END AS reviewer_label, 't3_' || k || '; t3_' || (k + 1) AS seeds FROM x WHERE len(problems) = 0"""

QUERIES = {f.__name__: f for f in (v15_decision_faults, v8_conversion_problems, v8_converted, e1_review_table, e2_incidents)}
ORACLE = {"v15_decision_faults": _V15, "v8_conversion_problems": _V8P, "v8_converted": _V8C, "e1_review_table": _E1, "e2_incidents": _E2}
