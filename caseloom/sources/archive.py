"""The archive of monthly Parquet shards: inventory, selection, canonical records, file sinks."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import typed_id

# fixed value of the source contract
SHARD_PATH = r"data/(comments|submissions)/(\d{4})/(\d{2})/[^/]+\.parquet$"

RECORD = "id string, name string, author string, title string, selftext string, body string, subreddit string, link_id string, parent_id string, created_utc bigint, num_comments bigint, permalink string, url string, crosspost_parent string, over_18 boolean, score bigint"


def inventory(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """(kind, month, path, bytes, revision) of every shard under root; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", "length")
    part = lambda i: F.regexp_extract("path", SHARD_PATH, i)
    return files.where(F.col("path").rlike(SHARD_PATH)).select(part(1).alias("kind"), F.concat_ws("-", part(2), part(3)).alias("month"), "path", F.col("length").alias("bytes"), F.lit(revision).alias("revision"))


def select_files(manifest: DataFrame, kinds: list[str] | None = None, start: str | None = None, end: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Files in scope, submissions first, newest month first, then by path. Empty lists restrict nothing; an unknown path is an error."""
    out = manifest
    if paths:
        known = {r["path"] for r in manifest.where(F.col("path").isin(paths)).select("path").collect()}
        if set(paths) - known:
            raise ValueError(f"not in the inventory: {sorted(set(paths) - known)}")
        out = out.where(F.col("path").isin(paths))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if start:
        out = out.where(F.col("month") >= start)
    if end:
        out = out.where(F.col("month") <= end)
    return out.orderBy(F.col("kind") != "submissions", F.col("month").desc(), "path")


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw records; columns that a shard lacks are null."""
    return spark.read.schema(RECORD).parquet(*paths).select("*", F.col("_metadata.file_path").alias("source_path"))


def row_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, rows) of files, from a scan that reads no column."""
    return spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("source_path")).agg(F.count("*").alias("rows"))


def canonical(raw: DataFrame, kind: str, site: str) -> tuple[DataFrame, DataFrame]:
    """Records with typed ids, thread and permalink, and the rows set aside because an id is missing or a comment's thread is no submission."""
    if kind == "submissions":
        me = typed_id(F.col("id"), "t3")
        thread, parent = me, F.lit(None).cast("string")
    else:
        me = typed_id(F.col("id"), "t1")
        thread, parent = typed_id(F.col("link_id"), "t3"), typed_id(F.col("parent_id"), "t1")
    rows = raw.withColumns({"kind": F.lit(kind), "typed_id": me, "thread_id": thread, "parent_id": parent})
    good = F.coalesce(F.startswith("thread_id", F.lit("t3_")) & F.startswith("typed_id", F.lit("t3_" if kind == "submissions" else "t1_")), F.lit(False))
    return rows.where(good).withColumn("canonical_permalink", permalink(site, F.col("thread_id"), F.col("typed_id"))), rows.where(~good)


def permalink(site: str, thread: Column, me: Column) -> Column:
    at = F.concat(F.lit(f"{site}/comments/"), F.substring(thread, 4, 1 << 30), F.lit("/"))
    return F.when(F.startswith(me, F.lit("t1_")), F.concat(at, F.lit("_/"), F.substring(me, 4, 1 << 30), F.lit("/"))).otherwise(at)


def csv_text(headers: list[str], rows) -> str:
    """CSV for spreadsheets: BOM, nested values as JSON, a leading apostrophe where a cell would be a formula."""
    out = io.StringIO()
    out.write("﻿")
    w = csv.writer(out)
    w.writerow(headers)
    for row in rows:
        w.writerow([_literal(json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, list | dict) else v) for v in row])
    return out.getvalue()


def _literal(v):
    return "'" + v if isinstance(v, str) and v.lstrip()[:1] in ("=", "+", "-", "@") and v.strip() else v


def write_csv(df: DataFrame, path: str) -> None:
    """df as part files, cells escaped in the JVM, each file with its header. Use csv_text for one small table with a BOM."""
    from caseloom.functions.text import sheet_literal

    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType.typeName()
        cols.append((F.to_json(c) if t in ("struct", "array", "map") else sheet_literal(c) if t == "string" else c).alias(f.name))
    df.select(*cols).write.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
