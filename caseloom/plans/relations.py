"""Registered queries of selection and summary operators over the driver's tables, and SQL of their own for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.operators import matcher, selection, summaries
from caseloom.plans.catalog import _REC, SITE, _records, _t
from caseloom.sources import archive


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotations: quality 1 is Yes, 0 No; toxic ones are pending."""
    label = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").otherwise("Unsure")
    return _t(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("record_id"), (F.col("doc_id") % 100).alias("thread_id"), label.alias("label"), F.when(F.col("toxic") == 1, "pending_review").otherwise("reviewed").alias("review_status")
    )


_REVIEWS = """v AS (SELECT doc_id AS record_id, doc_id % 100 AS thread_id, CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'Unsure' END AS label,
  CASE WHEN toxic = 1 THEN 'pending_review' ELSE 'reviewed' END AS review_status FROM labels)"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four words of benchmark items as phrases of sheets, with a copy of each third in the aggregate sheet."""
    b = _t(spark, sf_dir, "benchmark")
    four = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    own = b.select(F.concat(F.lit("sheet "), F.col("item_id") % 3).alias("sheet"), F.col("item_id").alias("row"), tx.normalize_column(four).alias("normalized"))
    more = b.where("item_id % 3 = 0").select(F.lit(summaries.AGGREGATE_SHEET).alias("sheet"), F.col("item_id").alias("row"), tx.normalize_column(F.upper(four)).alias("normalized"))
    return own.unionByName(more)


_PHRASES = rf"""b AS (SELECT item_id, replace(lower(trim(regexp_replace(array_to_string(string_split(text, ' ')[1:4], ' '), '\s+', ' ', 'g'))), 'ß', 'ss') AS n FROM benchmark),
p AS (SELECT 'sheet ' || item_id % 3 AS sheet, item_id AS row, n AS normalized FROM b UNION ALL SELECT '{summaries.AGGREGATE_SHEET}', item_id, n FROM b WHERE item_id % 3 = 0)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shards: a month, a kind, bytes, rows."""
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_orderstatus") == "O", "submissions").otherwise("comments").alias("kind"), F.col("o_custkey").alias("bytes"),
        F.when(F.col("o_orderstatus") == "P", "partial").otherwise("complete").alias("status"), F.col("o_orderkey").alias("scanned"), (F.col("o_orderkey") % 7).alias("candidates"),
    )


_FILES = """f AS (SELECT o_orderkey AS path, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderstatus = 'O' THEN 'submissions' ELSE 'comments' END AS kind, o_custkey AS bytes,
  CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'complete' END AS status, o_orderkey AS scanned, o_orderkey % 7 AS candidates FROM orders)"""


def p2_target_ids(spark, sf_dir):
    r = _records(spark, sf_dir)
    targets = _t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return selection.of_targets(r, "thread_id", targets).select("typed_id")


def p3_case_insensitive_set(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(selection.in_any_case(F.col("source"), ["SRC1", "src2"])).where(selection.in_any_case(F.col("lang"), [])).select("doc_id", "source")


def p4_necessary_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(selection.holds_a_word(["text", "source"], ["license", "licensed", "copyright", "src11"])).select("doc_id")


def p7_complete_targets(spark, sf_dir):
    """Conversations as cases whose turns' lengths name threads, orders' customers as context files."""
    members = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seed_key"), (F.length("text") % 5).cast("long").alias("thread"))
    files = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("path"), F.lit("complete").alias("status"), (F.col("o_orderkey") % 6).alias("target")).where("target + path % 3 <> 4")
    return selection.complete_targets(files, members)


def p8_eligible_seeds(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("created_utc"))
    return selection.until_month(e, "created_utc", "2024-01").where("event_id % 3 = 0").select("event_id", selection.month_of(F.col("created_utc")).alias("month"))


def p10_not_collected(spark, sf_dir):
    new, known = selection.not_collected(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels"), "doc_id")
    return new.crossJoin(F.broadcast(known))  # one row


def j1_semi_join(spark, sf_dir):
    return selection.of_targets(_t(spark, sf_dir, "conversations"), "conv_id", _t(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("t3_"), "doc_id"))).select("conv_id", "turn")


def j2_joined_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang").distinct()


def j3_containing_post(spark, sf_dir):
    r = _records(spark, sf_dir)
    out = selection.with_post(r.where("kind = 'comments'"), r.where("kind = 'submissions'"), ["author", "selftext"])
    return out.select("typed_id", "post_author", F.length("post_selftext").cast("long").alias("post_chars"))


def j6_families(spark, sf_dir):
    hits = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("typed_id"), (F.col("doc_id") % 50).alias("query_id"))
    phrases = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).cast("string").alias("sheet"))
    return selection.families(hits, phrases)


def j7_missing_posts(spark, sf_dir):
    return selection.missing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


def j9_unresolved(spark, sf_dir):
    edges = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 3000).alias("target_thread"), (F.col("o_orderstatus") == "F").alias("supported"))
    return selection.unresolved_targets(edges, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("typed_id")))


def j13_posts_with_reviews(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    v = summaries.per_value(_reviews(spark, sf_dir), "record_id", labels=F.array_join(F.sort_array(F.collect_set("label")), "; "))
    return d.join(v, "record_id", "left").select("record_id", F.coalesce("n", F.lit(0)).alias("reviews"), "labels")


def a1_phrase_groups(spark, sf_dir):
    return summaries.phrase_groups(_phrases(spark, sf_dir))


def a2_phrase_audit(spark, sf_dir):
    return summaries.phrase_audit(_phrases(spark, sf_dir))


def a3_close_variants(spark, sf_dir):
    """Users' events as phrases that differ in punctuation only."""
    e = _t(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.element_at(F.array(F.lit("-"), F.lit(" "), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")), "event_type").alias("normalized"))
    return summaries.close_variants(e)


def t7_query_set_hash(spark, sf_dir):
    return summaries.query_set_hash(summaries.phrase_groups(_phrases(spark, sf_dir)))


def a4_records_per_kind(spark, sf_dir):
    return summaries.per_value(_records(spark, sf_dir), "kind")


def a6_checkpoints(spark, sf_dir):
    return summaries.per_value(_files(spark, sf_dir), "kind", "status", scanned=F.sum("scanned"))


def a7_comments_per_thread(spark, sf_dir):
    return summaries.per_value(_records(spark, sf_dir).where("kind = 'comments'"), "thread_id")


def a8_hit_summary(spark, sf_dir):
    return summaries.hit_summary(_records(spark, sf_dir).where(F.contains(F.coalesce("selftext", "body"), F.lit("the"))))


def a10_label_counts(spark, sf_dir):
    v = _reviews(spark, sf_dir)
    return summaries.label_counts(v.select(F.to_json(F.struct("label", "review_status", "record_id")).alias("json")))


def a11_best_checkpoint(spark, sf_dir):
    c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).alias("scanned"))
    return summaries.best_checkpoints(c)


def a13_text_states(spark, sf_dir):
    return summaries.text_states(_records(spark, sf_dir), ["selftext", "body", "author"])


def a14_source_frequency(spark, sf_dir):
    return summaries.per_value(_t(spark, sf_dir, "documents"), "source")


def a15_inventory(spark, sf_dir):
    return summaries.inventory(_files(spark, sf_dir))


def u2_months_of_one_kind(spark, sf_dir):
    return summaries.months_of_one_kind(_files(spark, sf_dir).where("path % 40 = 0 OR kind = 'comments'"))


def a16_label_summary(spark, sf_dir):
    return summaries.label_summary(_reviews(spark, sf_dir))


def a18_snapshot(spark, sf_dir):
    return summaries.snapshot(_files(spark, sf_dir))


def a22_deleted_comments(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("body", F.when(F.col("created_utc") % 3 == 1, "[deleted]").otherwise(F.col("body")))
    return summaries.deleted_comments(r)


def a23_agreement(spark, sf_dir):
    p = _t(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("trial"), F.lit(0).alias("expected"), F.col("toxic").alias("actual"))
    return summaries.agreement(p, "trial", 10)


def d8_counted_rows(spark, sf_dir):
    f = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("complete").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("filtered"),
        (F.col("o_custkey") * 2).alias("footer_rows"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("returned_rows"),
    )
    return summaries.counted(f).select("path", "searched", "whole")


def t6_hit_ids(spark, sf_dir):
    """Matches of benchmark items in documents with their source spans, quotes and identities."""
    phrases = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), tx.normalize_column(F.col("text")).alias("normalized"))
    hits = matcher.find_phrases(_t(spark, sf_dir, "documents"), phrases, "doc_id", ["text"])
    ident = summaries.hit_id(F.concat(F.lit("t3_"), "doc_id"), F.col("query_id"), F.col("field"), F.col("start"), F.col("end"), "rev1")
    return hits.select("doc_id", "query_id", "field", F.col("start").cast("long").alias("raw_start"), F.col("end").cast("long").alias("raw_end"), "quote", "context", ident.alias("hit_id")).dropDuplicates(["hit_id"])


#: the documents' white space is single blanks and line ends, and of their characters ß alone grows when folded; x and y undo that
_T6 = r"""
WITH d AS (SELECT doc_id, text, replace(regexp_replace(lower(text), '\n', ' ', 'g'), 'ß', 'ss') AS t FROM documents), p AS (SELECT item_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS p FROM benchmark),
m AS (SELECT doc_id, item_id, text, t, p, unnest(generate_series(1, length(t) - length(p) + 1)) AS s FROM d JOIN p ON contains(t, p) WHERE length(p) > 0),
h AS (SELECT doc_id, item_id, text, s - 1 AS a, s - 1 + length(p) AS b, t, p FROM m WHERE substr(t, s, length(p)) = p
  AND NOT (s > 1 AND regexp_matches(substr(t, s - 1, 1), '[\pL\pN]') AND regexp_matches(substr(p, 1, 1), '[\pL\pN]'))
  AND NOT (s + length(p) <= length(t) AND regexp_matches(substr(t, s + length(p), 1), '[\pL\pN]') AND regexp_matches(substr(p, length(p), 1), '[\pL\pN]'))),
o AS (SELECT doc_id, item_id, text, a, b, (SELECT min(k) FROM generate_series(0, length(text)) g(k) WHERE k + length(substr(text, 1, k)) - length(replace(substr(text, 1, k), 'ß', '')) >= a) AS x,
  (SELECT min(k) FROM generate_series(0, length(text)) g(k) WHERE k + length(substr(text, 1, k)) - length(replace(substr(text, 1, k), 'ß', '')) >= b) AS y FROM h)
SELECT doc_id, CAST(item_id AS VARCHAR) AS query_id, 'text' AS field, x AS raw_start, y AS raw_end, substr(text, x + 1, y - x) AS quote, substr(text, greatest(x - 120, 0) + 1, y + 120 - greatest(x - 120, 0)) AS context,
  sha256(concat_ws(chr(31), 't3_' || doc_id, item_id, 'text', x, y, 'rev1')) AS hit_id FROM o
"""


def w1_round_robin(spark, sf_dir):
    return selection.round_robin(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 150)


def w2_first_two(spark, sf_dir):
    return selection.first_of(_t(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 2)


def w4_latest(spark, sf_dir):
    return selection.first_of(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


def w7_month_choice(spark, sf_dir):
    return selection.month_choice(_files(spark, sf_dir))


def w8_last_seed(spark, sf_dir):
    return selection.first_of(_t(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")])


def _placed(df: DataFrame, order: list, key: str) -> DataFrame:
    from caseloom.operators.exports import numbered

    return numbered(df, order, "place").select(key, "place")


def o2_context_order(spark, sf_dir):
    return _placed(_files(spark, sf_dir), selection.context_order(), "path")


def o4_post_order(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.concat(F.lit("t3_"), "event_id").alias("typed_id"), F.when(F.col("event_id") % 10 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("created_utc"))
    return _placed(e, selection.post_order(), "typed_id")


def o9_calibration_first(spark, sf_dir):
    return _placed(_t(spark, sf_dir, "documents").select(F.concat(F.lit("i_"), "doc_id").alias("incident_id")), selection.calibration_first(["i_7", "i_3", "i_99"], "incident_id"), "incident_id")


def o10_last_errors(spark, sf_dir):
    e = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return e.select("doc_id", F.sha2(F.array_join(selection.last_errors(F.col("w"), 100), " "), 256).alias("last_sha256"))


def u1_only_here(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").subtract(_t(spark, sf_dir, "labels").select("doc_id"))


def u3_union_targets(spark, sf_dir):
    held = selection.union_of(_t(spark, sf_dir, "labels").select("doc_id"))
    return selection.add_targets(held, selection.union_of(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))), 450)


def u7_overlap(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id").intersect(_t(spark, sf_dir, "conversations").select("conv_id"))


def f3_permalinks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("x"), "turn").alias("id"), F.concat(F.lit("t3_"), "conv_id").alias("link_id"), F.lit(None).cast("string").alias("parent_id"))
    return archive.canonical(c, "comments", SITE)[0].select("typed_id", "canonical_permalink")


def f12_sheet_cells(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    cell = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 4 == 1, F.lit("2024-01-02T03:04:05Z")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" =1+"), "doc_id")).otherwise(F.col("lang"))
    return d.select("doc_id", tx.sheet_cell(cell).alias("cell"))


def f33_account_age(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    created = F.lit(1705000000)
    return e.select("event_id", tx.account_age(F.col("t"), created).alias("age"), tx.utc_date(F.col("t")).alias("day"), tx.month_number(selection.month_of(F.col("t"))).alias("month"))


NAMES = [k for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_"]
QUERIES = {k: globals()[k] for k in NAMES}
ORACLE = {
    "p2_target_ids": f"WITH {_REC} SELECT typed_id FROM r WHERE thread_id IN (SELECT 't3_' || doc_id FROM labels WHERE toxic = 1)",
    "p3_case_insensitive_set": "SELECT doc_id, source FROM documents WHERE source ILIKE 'src1' OR source ILIKE 'src2'",
    "p4_necessary_words": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(source, 'src11')",
    "p7_complete_targets": """WITH m AS (SELECT DISTINCT conv_id AS k, length(text) % 5 AS t FROM conversations), f AS (SELECT DISTINCT o_custkey % 50 AS p, o_orderkey % 6 AS t FROM orders WHERE o_orderkey % 6 + o_custkey % 50 % 3 <> 4)
SELECT k AS seed_key, (SELECT count(*) FROM (SELECT DISTINCT p FROM f) q WHERE NOT EXISTS (SELECT 1 FROM m m2 WHERE m2.k = m.k AND NOT EXISTS (SELECT 1 FROM f WHERE f.p = q.p AND f.t = m2.t))) AS files FROM m GROUP BY k""",
    "p8_eligible_seeds": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '1970-01' ELSE strftime(ts, '%Y-%m') END AS month FROM events WHERE event_id % 3 = 0 AND (event_id % 10 = 0 OR ts < TIMESTAMP '2024-02-01')",
    "p10_not_collected": "SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS known_matches FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j1_semi_join": "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "j2_joined_ids": "SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "j3_containing_post": f"WITH {_REC} SELECT c.typed_id, p.role AS post_author, length(p.text) AS post_chars FROM r c LEFT JOIN r p ON p.post AND p.typed_id = c.thread_id WHERE NOT c.post",
    "j6_families": "SELECT DISTINCT doc_id AS typed_id, CAST(item_id % 3 AS VARCHAR) AS family FROM documents JOIN benchmark ON item_id = doc_id % 50",
    "j7_missing_posts": "SELECT DISTINCT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id",
    "j9_unresolved": "SELECT DISTINCT o_custkey % 3000 AS target_thread FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3000 NOT IN (SELECT doc_id FROM documents)",
    "j13_posts_with_reviews": f"WITH {_REVIEWS} SELECT doc_id AS record_id, count(v.record_id) AS reviews, string_agg(DISTINCT label, '; ' ORDER BY label) AS labels FROM documents LEFT JOIN v ON doc_id = record_id GROUP BY doc_id",
    "a1_phrase_groups": f"WITH {_PHRASES} SELECT normalized, 'q_' || substr(sha256(normalized), 1, 16) AS query_id, count(*) AS origins, min(row) AS first_row, string_agg(DISTINCT sheet, '; ' ORDER BY sheet) AS sheets FROM p GROUP BY normalized",
    "a2_phrase_audit": f"""WITH {_PHRASES}, a AS (SELECT DISTINCT normalized FROM p WHERE sheet = '{summaries.AGGREGATE_SHEET}'), c AS (SELECT DISTINCT normalized FROM p WHERE sheet <> '{summaries.AGGREGATE_SHEET}')
SELECT count(*) AS original, count(DISTINCT normalized) AS uniq, count(*) - count(DISTINCT normalized) AS duplicates, (SELECT count(*) FROM (FROM a EXCEPT FROM c)) AS aggregate_only, (SELECT count(*) FROM (FROM c EXCEPT FROM a)) AS category_only FROM p""",
    "a3_close_variants": "SELECT letters, count(*) AS variants FROM (SELECT DISTINCT user_id || event_type AS letters, event_id % 3 AS k FROM events) GROUP BY letters HAVING count(*) > 1",
    "t7_query_set_hash": f"WITH {_PHRASES} SELECT sha256(string_agg(q, chr(10) ORDER BY q)) AS query_set_hash FROM (SELECT DISTINCT 'q_' || substr(sha256(normalized), 1, 16) AS q FROM p)",
    "a4_records_per_kind": "SELECT CASE turn WHEN 0 THEN 'submissions' ELSE 'comments' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
    "a6_checkpoints": f"WITH {_FILES} SELECT kind, status, count(*) AS n, CAST(sum(scanned) AS BIGINT) AS scanned FROM f GROUP BY ALL",
    "a7_comments_per_thread": "SELECT 't3_' || conv_id AS thread_id, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY conv_id",
    "a8_hit_summary": "SELECT count(*) AS hits, count(DISTINCT conv_id || 'x' || turn) AS records, count(DISTINCT conv_id) AS threads FROM conversations WHERE contains(text, 'the')",
    "a10_label_counts": f"WITH {_REVIEWS} SELECT label, review_status, count(*) AS n FROM v GROUP BY ALL",
    "a11_best_checkpoint": "SELECT o_custkey AS path, arg_min(o_orderkey, (2 - o_orderkey % 3) * 100000000 + o_orderkey) AS key, max(o_orderkey % 3) AS scanned FROM orders GROUP BY o_custkey",
    "a13_text_states": f"""WITH {_REC} SELECT field, CASE WHEN v IS NULL THEN 'null' WHEN v = '' THEN 'empty' WHEN v IN ('[deleted]', '[removed]') THEN 'placeholder' ELSE 'text' END AS state, count(*) AS n
FROM (SELECT 'selftext' AS field, CASE WHEN post THEN text END AS v FROM r UNION ALL SELECT 'body', CASE WHEN NOT post THEN text END FROM r UNION ALL SELECT 'author', role FROM r) GROUP BY ALL""",
    "a14_source_frequency": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "a15_inventory": f"WITH {_FILES} SELECT kind, count(*) AS shards, CAST(sum(bytes) AS BIGINT) AS bytes, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS months FROM f GROUP BY kind",
    "u2_months_of_one_kind": f"""WITH {_FILES}, g AS (SELECT * FROM f WHERE path % 40 = 0 OR kind = 'comments') SELECT month, 'comments' AS kind FROM (SELECT month FROM g WHERE kind = 'comments' EXCEPT SELECT month FROM g WHERE kind = 'submissions')
UNION ALL SELECT month, 'submissions' FROM (SELECT month FROM g WHERE kind = 'submissions' EXCEPT SELECT month FROM g WHERE kind = 'comments')""",
    "a16_label_summary": """SELECT count(*) AS incidents, count(*) FILTER (quality = 1 AND toxic IS DISTINCT FROM 1) AS yes, count(*) FILTER (quality = 0 AND toxic IS DISTINCT FROM 1) AS no, count(*) FILTER (quality IS NULL AND toxic IS DISTINCT FROM 1) AS unsure,
  count(*) FILTER (toxic = 1) AS pending, count(DISTINCT doc_id) AS records, count(DISTINCT doc_id % 100) AS threads FROM labels""",
    "a18_snapshot": f"""WITH {_FILES}, s AS (SELECT kind, count(*) AS files, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status <> 'complete') AS remaining, CAST(coalesce(sum(scanned) FILTER (status = 'complete'), 0) AS BIGINT) AS scanned,
  CAST(sum(candidates) AS BIGINT) AS candidates FROM f GROUP BY kind) FROM s UNION ALL SELECT NULL, CAST(sum(files) AS BIGINT), CAST(sum(completed) AS BIGINT), CAST(sum(remaining) AS BIGINT), CAST(sum(scanned) AS BIGINT), CAST(sum(candidates) AS BIGINT) FROM s""",
    "a22_deleted_comments": "SELECT 't3_' || conv_id AS thread_id, count(*) AS comments, count(*) FILTER (turn % 3 = 1 OR text IN ('[deleted]', '[removed]')) AS deleted FROM conversations WHERE turn > 0 GROUP BY conv_id",
    "a23_agreement": "SELECT doc_id % 40 AS trial, count(*) AS cases, count(*) = 10 AND count(*) FILTER (toxic = 0) = 10 AS agree FROM labels GROUP BY 1",
    "d8_counted_rows": """SELECT o_orderkey AS path, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' THEN o_custkey * 2 WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS searched,
  o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' AS whole FROM orders""",
    "t6_hit_ids": _T6,
    "w1_round_robin": """WITH l AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS lap FROM documents), o AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY lap, lang, source, doc_id) AS place FROM l)
SELECT doc_id, lang, source, place FROM o WHERE place <= 150""",
    "w2_first_two": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2",
    "w4_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "w7_month_choice": f"WITH {_FILES}, m AS (SELECT kind, list_sort(list(DISTINCT month)) AS m FROM f GROUP BY kind) SELECT kind, m[1] AS first_month, m[len(m) // 2 + 1] AS middle_month, m[len(m)] AS last_month FROM m",
    "w8_last_seed": "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id",
    "o2_context_order": f"WITH {_FILES} SELECT path, row_number() OVER (ORDER BY kind <> 'submissions', month, path) AS place FROM f",
    "o4_post_order": "SELECT 't3_' || event_id AS typed_id, row_number() OVER (ORDER BY CASE WHEN event_id % 10 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END, 't3_' || event_id) AS place FROM events",
    "o9_calibration_first": "SELECT 'i_' || doc_id AS incident_id, row_number() OVER (ORDER BY doc_id NOT IN (3, 7, 99), 'i_' || doc_id) AS place FROM documents",
    "o10_last_errors": "SELECT doc_id, sha256(array_to_string(w[greatest(len(w) - 99, 1):], ' ')) AS last_sha256 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)",
    "u1_only_here": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "u3_union_targets": """WITH h AS (SELECT DISTINCT doc_id FROM labels), n AS (SELECT doc_id FROM documents UNION SELECT conv_id FROM conversations EXCEPT SELECT doc_id FROM h)
SELECT doc_id FROM h UNION ALL SELECT doc_id FROM n QUALIFY row_number() OVER (ORDER BY doc_id) <= greatest(0, 450 - (SELECT count(*) FROM h))""",
    "u7_overlap": "SELECT doc_id FROM labels INTERSECT SELECT conv_id FROM conversations",
    "f3_permalinks": f"SELECT 't1_' || conv_id || 'x' || turn AS typed_id, '{SITE}/comments/' || conv_id || '/_/' || conv_id || 'x' || turn || '/' AS canonical_permalink FROM conversations",
    "f12_sheet_cells": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '''' || doc_id WHEN 1 THEN '''2024-01-02T03:04:05Z' WHEN 2 THEN ''' =1+' || doc_id ELSE lang END AS cell FROM documents",
    "f33_account_age": """SELECT event_id, CASE WHEN t >= 1705000000 THEN t - 1705000000 END AS age, strftime(ts, '%Y-%m-%d') AS day, CAST(strftime(ts, '%Y%m') AS INTEGER) AS month FROM (SELECT event_id, ts, epoch_us(ts) // 1000000 AS t FROM events)""",
}
