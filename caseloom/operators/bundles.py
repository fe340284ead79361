"""Case bundles: context of the seeds from a partitioned archive, one bundle for each seed group, rewritten only where its content changed.

A bundle is a header row and rows of records under its incident_id; it is never gathered into one value, so a case of any size fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.cases import extract_links, group_seeds
from caseloom.operators.graph import incident_id
from caseloom.operators.selection import month_of
from caseloom.plans.scratch import written
from caseloom.plans.versions import merge_changed

# fixed values of the coverage contract
OUTSIDE = "outside_archive_coverage; public Reddit access probe returned HTTP 403"
PENDING = "context_collection_pending_or_partial"
WINDOW = "Comments outside the declared archive window are unavailable"


def context_window(seeds: DataFrame, held: DataFrame, last_month: str) -> dict[str, str | None]:
    """first: month of the earliest containing post, null (all months) while any is unknown; last: latest month of an eligible seed. One row reaches the driver.

    seeds: thread_id, created_utc; held: posts already here (typed_id, created_utc). A seed is eligible if its month is not after last_month."""
    s = seeds.where(F.col("thread_id").isNotNull()).select("thread_id", month_of(F.col("created_utc")).alias("m")).where(F.col("m") <= last_month)
    posts = held.select(F.col("typed_id").alias("thread_id"), F.when(F.col("created_utc") != 0, month_of(F.col("created_utc"))).alias("pm"))
    r = s.join(posts, "thread_id", "left").agg(F.max("m").alias("last"), F.min("pm").alias("first"), F.count_if(F.col("pm").isNull()).alias("unknown")).first()
    return {"first": None if r["unknown"] else r["first"], "last": r["last"]}


def collect_context(archive: DataFrame, seeds: DataFrame, held: DataFrame, last_month: str) -> tuple[DataFrame, DataFrame]:
    """(records, threads): containing posts that are not held yet, then the comments of all eligible threads; and each eligible thread's state.

    archive: canonical records partitioned by kind and month. Posts are looked for up to the latest eligible seed's month (a comment is never older than its post), comments
    from the earliest post's month to last_month: both are literals on partition columns by then, so other months are not listed, let alone read.
    threads: thread_id, containing_post_retrieved, comments, first_month, last_month, comments_query_complete.
    """
    w = context_window(seeds, held, last_month)
    targets = seeds.where(F.col("thread_id").isNotNull() & (month_of(F.col("created_utc")) <= last_month)).select("thread_id").distinct()
    missing = targets.join(held.select(F.col("typed_id").alias("thread_id")), "thread_id", "left_anti")
    posts = archive.where((F.col("kind") == "submissions") & (F.col("month") <= (w["last"] or ""))).join(missing.select(F.col("thread_id").alias("typed_id")), "typed_id", "left_semi")
    posts = written(posts, "posts")  # few; they decide how far back the comments go
    known = held.select("typed_id", "created_utc").unionByName(posts.select("typed_id", "created_utc"))
    w = context_window(seeds, known, last_month)
    comments = archive.where((F.col("kind") == "comments") & (F.col("month") >= (w["first"] or "")) & (F.col("month") <= last_month)).join(targets, "thread_id", "left_semi")
    comments = written(comments.select(*posts.columns), "comments")
    per = comments.groupBy("thread_id").agg(F.count("*").alias("comments"))
    here = known.select(F.col("typed_id").alias("thread_id"), F.lit(True).alias("containing_post_retrieved")).distinct()
    threads = targets.join(here, "thread_id", "left").join(per, "thread_id", "left").select(
        "thread_id", F.coalesce("containing_post_retrieved", F.lit(False)).alias("containing_post_retrieved"), F.coalesce("comments", F.lit(0)).cast("long").alias("comments"),
        F.lit(w["first"]).cast("string").alias("first_month"), F.lit(last_month).alias("last_month"), F.lit(True).alias("comments_query_complete"),
    )
    return posts.unionByName(comments), threads


def _sum_hash(row: Column) -> list[Column]:
    """Four sums that depend on all rows but not on their order."""
    h = F.sha2(row, 256)
    return [F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 13, 25, 37)]


def post_bundles(records: DataFrame, hits: DataFrame, threads: DataFrame, revision: str, last_month: str, fields: tuple[str, ...] = ("title", "selftext", "body"), skip: tuple[str, ...] = ("retrieved_at",)) -> tuple[DataFrame, DataFrame]:
    """(headers, members): a collection unit for each seed group, with its thread's records only; no original is invented.

    records: typed_id, thread_id, kind, author, created_utc, the fields and others; hits: typed_id; threads: of collect_context. headers: incident_id, seed_key, seed_record_ids, seed_thread_id,
    original_post_id, original_resolution_status, records, retrieved_comments, missing_submissions, unresolved_related, comments_collected, comments_missing_reason, complete_case (never true),
    content_hash; members: incident_id, content_hash and the records. The hash covers the records but for `skip`, the coverage and the seeds.
    """
    thread = records.select(F.col("typed_id").alias("first"), F.col("thread_id").alias("seed_thread_id"), F.col("created_utc").alias("seed_utc"))
    groups = group_seeds(hits, records).withColumn("first", F.element_at("members", 1)).join(thread, "first")
    posts = records.where("kind = 'submissions'").select(F.col("typed_id").alias("seed_thread_id"), F.col("author").alias("op"), F.col("created_utc").alias("op_utc"), F.lit(True).alias("post"))
    groups = groups.join(posts, "seed_thread_id", "left").join(threads.select(F.col("thread_id").alias("seed_thread_id"), F.col("comments_query_complete").alias("collected")), "seed_thread_id", "left")
    groups = written(groups.withColumn("incident_id", incident_id(revision, F.col("seed_key"))), "groups")

    used = groups.select(F.col("seed_thread_id").alias("thread_id")).distinct()
    own = records.join(used, "thread_id", "left_semi")
    row = F.to_json(F.struct(*[c for c in records.columns if c not in skip]), {"ignoreNullFields": "false"})
    per = own.groupBy("thread_id").agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "comments").alias("retrieved_comments"), *_sum_hash(row))
    linked = own.join(posts.select(F.col("seed_thread_id").alias("thread_id"), F.col("op").alias("original_author")), "thread_id", "left")
    links = None
    for f in fields:
        part = extract_links(linked, f).where("supported").select("source_thread", "target_thread")
        links = part if links is None else links.unionByName(part)
    lost = links.distinct().join(records.select(F.col("typed_id").alias("target_thread")), "target_thread", "left_anti").groupBy(F.col("source_thread").alias("thread_id")).agg(F.count("*").alias("unresolved_related"))

    out = groups.join(per.withColumnRenamed("thread_id", "seed_thread_id"), "seed_thread_id", "left").join(lost.withColumnRenamed("thread_id", "seed_thread_id"), "seed_thread_id", "left")
    post, collected = F.coalesce("post", F.lit(False)), F.coalesce("collected", F.lit(False))
    outside = month_of(F.coalesce("op_utc", "seed_utc")) > last_month
    head = out.select(
        "incident_id", "seed_key", F.col("members").alias("seed_record_ids"), "seed_thread_id", F.when(post, F.col("seed_thread_id")).alias("original_post_id"), F.when(post, "provisional seed thread").otherwise("unresolved").alias("original_resolution_status"),
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("retrieved_comments", F.lit(0)).alias("retrieved_comments"), F.when(post, 0).otherwise(1).alias("missing_submissions"), F.coalesce("unresolved_related", F.lit(0)).alias("unresolved_related"),
        collected.alias("comments_collected"), F.when(collected, WINDOW).when(outside, OUTSIDE).otherwise(PENDING).alias("comments_missing_reason"), F.lit(False).alias("complete_case"), "s1", "s13", "s25", "s37",
    )
    covered = [c for c in head.columns if c not in ("incident_id", "seed_key")]
    head = head.withColumn("content_hash", F.sha2(F.to_json(F.struct(*covered), {"ignoreNullFields": "false"}), 256)).drop("s1", "s13", "s25", "s37")
    head = written(head, "headers")
    members = head.select("incident_id", "content_hash", F.col("seed_thread_id").alias("thread_id")).join(own, "thread_id")
    return head, members


def save_bundles(headers: DataFrame, members: DataFrame, root: str, buckets: int = 64) -> dict[str, int]:
    """Merge both tables into the versioned state under root; buckets without a changed case keep their files. The records go first: a header never points at records that are not there."""
    merge_changed(members, "incident_id", "content_hash", f"{root}/members", buckets)
    return merge_changed(headers, "incident_id", "content_hash", f"{root}/headers", buckets)

