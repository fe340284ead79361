"""Registered queries of the library's own data sources: what is written as shards or workbooks is read back, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions.text import text_parts
from caseloom.plans.catalog import _t
from caseloom.plans.scratch import new_folder
from caseloom.sources import shards, sheets


def _archive(spark, sf_dir, *more: str) -> str:
    """Documents as shards: English ones as submissions, without a source before 2005; others as comments, their n_chars a text from 2010 on."""
    shards.register(spark)
    root = new_folder(spark, "archive")
    k = F.col("doc_id")
    d = _t(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "submissions").otherwise("comments").alias("kind"), F.format_string("20%02d-%02d", k % 20, k % 12 + 1).alias("month"), "doc_id", "source", "n_chars", *more)
    early, late = (F.col("kind") == "submissions") & (F.col("month") < "2005-01"), (F.col("kind") == "comments") & (F.col("month") >= "2010-01")
    shards.write_shards(d.where(early).drop("source"), root)
    shards.write_shards(d.where(late).withColumn("n_chars", F.concat(F.lit("about "), "n_chars")), root)
    shards.write_shards(d.where(~early & ~late), root)
    return root


def s2_presence(spark, sf_dir):
    p = shards.presence(spark.read.format("shard_footers").load(_archive(spark, sf_dir)))
    return p.select("kind", "column", (F.col("absent") > 0).alias("lacking"), "first_month", "last_month", F.array_join("types", ",").alias("types"))


def s3_footer_rows(spark, sf_dir):
    return spark.read.format("shard_footers").load(_archive(spark, sf_dir)).groupBy("kind", "month").agg(F.sum("rows").alias("rows"))


def s1_shard_records(spark, sf_dir):
    """Records of fifteen years with their whole texts; columns found in footers: n_chars widened to text, source null where a shard has none."""
    r = spark.read.format("shards").options(start="2003-01", end="2017-12").load(_archive(spark, sf_dir, "text"))
    return r.select("doc_id", "kind", "month", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def s9_workbooks(spark, sf_dir):
    """Whole documents written as workbooks, a row for each 14,000 characters, and read back by sheet."""
    sheets.register(spark)
    folder = new_folder(spark, "workbooks")
    part = F.posexplode(text_parts(F.col("text"))).alias("part", "value")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") / 8).alias("eighths"), part)
    d.select("doc_id", "part", "eighths", F.concat(F.lit("="), "value").alias("text part")).write.format("workbook").option("sheet", "Texts").option("rows_per_part", 20_000).mode("append").save(folder)
    cell = lambda i: F.element_at("cells", i)
    rows = spark.read.format("workbook_sheets").option("sheets", '["Texts"]').load(folder).where("row > 1")
    return rows.select(cell("A").cast("long").alias("doc_id"), cell("B").cast("long").alias("part"), cell("C").cast("double").alias("eighths"), F.sha2(cell("D"), 256).alias("part_sha256"))


NAMES = [k for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_"]
QUERIES = {k: globals()[k] for k in NAMES}
_A = """a AS (SELECT CASE WHEN lang = 'en' THEN 'submissions' ELSE 'comments' END AS kind, printf('20%02d-%02d', doc_id % 20, doc_id % 12 + 1) AS month, doc_id, source, n_chars, text FROM documents)"""
_EARLY, _LATE = "(kind = 'submissions' AND month < '2005-01')", "kind = 'comments' AND month >= '2010-01'"
ORACLE = {
    "s2_presence": f"""WITH {_A}, c AS (SELECT kind, month, 'doc_id' AS col, 'bigint' AS t FROM a UNION ALL SELECT kind, month, 'n_chars', CASE WHEN {_LATE} THEN 'string' ELSE 'bigint' END FROM a
  UNION ALL SELECT kind, month, 'source', 'string' FROM a WHERE NOT {_EARLY}), n AS (SELECT kind, count(DISTINCT month) AS months FROM a GROUP BY kind)
SELECT kind, col AS "column", count(DISTINCT month) < any_value(months) AS lacking, min(month) AS first_month, max(month) AS last_month, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM c JOIN n USING (kind) GROUP BY kind, col""",
    "s3_footer_rows": f"WITH {_A} SELECT kind, month, count(*) AS rows FROM a GROUP BY kind, month",
    "s1_shard_records": f"""WITH {_A} SELECT doc_id, kind, month, CASE WHEN NOT {_EARLY} THEN source END AS source, CASE WHEN {_LATE} THEN 'about ' ELSE '' END || n_chars AS n_chars, sha256(text) AS text_sha256
FROM a WHERE month BETWEEN '2003-01' AND '2017-12'""",
    "s9_workbooks": """SELECT doc_id, part, CASE WHEN doc_id % 5 > 0 THEN n_chars / 8 END AS eighths, sha256('=' || substr(text, part * 14000 + 1, 14000)) AS part_sha256
FROM (SELECT doc_id, n_chars, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / 14000) AS BIGINT), 1) - 1)) AS part FROM documents)""",
}
