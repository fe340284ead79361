"""Links, preserved copies, seeds and history as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import real_author, typed_id
from caseloom.plans.scratch import unused

# fixed values of the case contract
SERIES_CUE = r"(?iu)\b(?:my (?:previous|original|earlier|last) (?:post|update)|original post|previous update|earlier update|next update|follow[- ]?up|update\s*[1-9]|part\s*[1-9]|(?:my|the) (?:first|second|third) post)\b"
EARLIER_CUE = r"(?iu)\b(original|previous|earlier|first)\b"
PRESERVATION_CUE = r"(?iu)(?:copy of (?:the )?(?:original|post)|original post (?:by|text)|preserv(?:ed|ation)|in case (?:this|it) (?:gets|is) deleted)"
THREAD_URL = r"(?i)(?:https?://(?:(?:www|old|np|new)\.)?reddit\.com)?/(?:r/[^/\s)]+/)?comments/([a-z0-9]+)(?:/[^\s<>\])]*?)?(?=[\s<>\])]|$)|https?://redd\.it/([a-z0-9]+)"
SITE_WORD = "reddit"
COPY_CHARS, REACH = 100, 180


def _urls(pattern: str, groups: tuple[int, ...]):
    """url, its span in code points, the id in it and its surroundings, for each match; one pass over a text."""
    find = re.compile(pattern, re.ASCII)  # classes and case as in Java's patterns without flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], [[] for _ in range(5)]
            for r, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for m in find.finditer(text):
                    at.append(r)
                    for out, v in zip(found, (m[0], *m.span(), max(m[g] or "" for g in groups), text[max(0, m.start() - REACH) : m.end() + REACH]), strict=True):
                        out.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=[*LINK_KEYS, "url", "url_start", "url_end", "named", "quote"])

    return run


LINK_KEYS = ("typed_id", "thread_id", "kind", "author", "original_author")


def extract_links(records: DataFrame, field: str, pattern: str = THREAD_URL, id_groups: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row per URL of a field: source and target thread, url, its code-point span, quote, relationship, supported.

    records: typed_id, thread_id, kind, author, original_author and the field. Only texts that a JVM pattern finds URLs in reach Python, which goes over each once and
    returns spans and quotes: what a row carries does not grow with the text.
    """
    text = F.coalesce(F.col(field), F.lit(""))
    schema = ", ".join(f"{k} string" for k in LINK_KEYS) + ", url string, url_start int, url_end int, named string, quote string"
    rows = records.where(text.rlike(pattern)).select(*[F.col(k).cast("string").alias(k) for k in LINK_KEYS], text.alias("text")).mapInArrow(_urls(pattern, id_groups), schema)
    rows = rows.withColumn("target_thread", typed_id(F.col("named")))
    op = real_author(F.col("original_author")) & F.coalesce(F.col("author") == F.col("original_author"), F.lit(False))
    supported = ((F.col("kind") == "submissions") | op) & F.col("quote").rlike(SERIES_CUE)
    relation = F.when(supported & F.col("quote").rlike(EARLIER_CUE), "points_to_earlier_post").when(supported, "explicit_series_reference").otherwise("unverified_related_candidate")
    return rows.where("target_thread IS NOT NULL AND target_thread <> thread_id").select(
        F.col("typed_id").alias("source_record_id"), F.col("thread_id").alias("source_thread"), "target_thread", F.lit(field).alias("field"), "url", "url_start", "url_end", "quote", relation.alias("relationship"), supported.alias("supported")
    )


def case_links(records: DataFrame, fields: tuple[str, ...] = ("title", "selftext", "body"), pattern: str = THREAD_URL) -> DataFrame:
    """All edges of records: those of URLs in the fields, and of crosspost_parent, which supports itself; with link_id.

    records: as in extract_links, the fields and crosspost_parent."""
    cross = records.where("crosspost_parent IS NOT NULL").select(
        F.col("typed_id").alias("source_record_id"), F.col("thread_id").alias("source_thread"), typed_id(F.col("crosspost_parent")).alias("target_thread"), F.lit("crosspost_parent").alias("field"),
        F.lit("attributed_crosspost").alias("relationship"), F.lit(True).alias("supported"),
    ).where("target_thread IS NOT NULL")
    out = cross
    for f in fields:
        out = out.unionByName(extract_links(records, f, pattern), allowMissingColumns=True)
    ident = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_record_id", "target_thread", "field", "url_start", "url", "relationship")]
    return out.withColumn("link_id", F.concat(F.lit("l_"), F.substring(F.sha2(F.concat_ws("\x1f", *ident), 256), 1, 20)))


def preservation(records: DataFrame, case: str = "seed_key", site: str = SITE_WORD) -> DataFrame:
    """For each post of a case the other records of the case that preserve it: (case, post_id, source_record_id, field, type, detection_status,
    completeness, created_utc), and a row of type 'none observed' for posts without any.

    A record preserves a post if it holds the post's whole trimmed text of COPY_CHARS characters or more, or if it holds a
    preservation cue and stands in the post's thread or names the post and the site. The join is keyed by the case.
    records: case, typed_id, thread_id, kind, author, created_utc, selftext, body. Null texts hold nothing.
    """
    own = F.regexp_replace(F.coalesce("selftext", F.lit("")), r"(?U)^\s+|\s+$", "")
    posts = records.where("kind = 'submissions'").select(case, F.col("typed_id").alias("post_id"), own.alias("_own"))
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("body", "selftext")])).alias("x")
    others = records.select(case, F.col("typed_id").alias("source_record_id"), "thread_id", "kind", "author", "created_utc", texts).where("x.text <> ''")
    copy = (F.length("_own") >= COPY_CHARS) & F.contains(F.col("x.text"), F.col("_own"))
    named = (F.col("thread_id") == F.col("post_id")) | (F.contains(F.col("x.text"), F.substring(F.col("post_id"), 4, 20)) & F.contains(F.col("x.text"), F.lit(site)))
    found = posts.join(others, case).where("post_id <> source_record_id").where(copy | (F.col("x.text").rlike(PRESERVATION_CUE) & named))
    comment = F.col("kind") == "comments"
    kind = F.when(comment & (F.col("author") == "AutoModerator"), "subreddit automod in comments").when(comment, "another Redditor in comments").otherwise("another subreddit")
    found = found.select(
        case, "post_id", "source_record_id", F.col("x.field").alias("field"), kind.alias("type"), F.when(copy, "exact text match").otherwise("candidate_requires_review").alias("detection_status"),
        F.when(copy, "full").otherwise("unknown").alias("completeness"), "created_utc",
    )
    none = posts.select(case, "post_id").join(found.select(case, "post_id"), [case, "post_id"], "left_anti").withColumn("type", F.lit("none observed")).withColumn("detection_status", F.lit("collected scope searched"))
    return found.unionByName(none, allowMissingColumns=True)


def group_seeds(hits: DataFrame, records: DataFrame) -> DataFrame:
    """(seed_key, members): a submission or a comment by the real original poster belongs to its thread, any other comment is its own case."""
    posts = records.where("kind = 'submissions'").select(F.col("typed_id").alias("_post"), F.col("author").alias("_op"))
    seeds = records.join(hits.select("typed_id").distinct(), "typed_id", "left_semi").join(posts, F.col("thread_id") == F.col("_post"), "left")
    own = real_author(F.col("author")) & F.coalesce(F.col("author") == F.col("_op"), F.lit(False))
    key = F.when((F.col("kind") == "submissions") | own, F.col("thread_id")).otherwise(F.col("typed_id"))
    return seeds.groupBy(key.alias("seed_key")).agg(F.sort_array(F.collect_set("typed_id")).alias("members"))


def exact_copies(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(post_id, copy_id) of texts whose trimmed content of COPY_CHARS characters or more is equal: each copy with the first of its group."""
    t = texts.select(F.col(id_col).alias("id"), F.trim(text_col).alias("t")).where(F.length("t") >= COPY_CHARS).select("id", F.sha2("t", 256).alias("h"))
    first = t.groupBy("h").agg(F.min("id").alias("post_id"), F.max("id").alias("last")).where("post_id <> last").drop("last")
    return t.join(first, "h").where("id <> post_id").select("post_id", F.col("id").alias("copy_id"))


def prior_activity(events: DataFrame, author: str, ts: str, kinds: dict[str, str], kind_col: str) -> DataFrame:
    """events with strictly earlier counts per kind of the same real author, and the number of kinds seen so far, this one included.

    Authors that are not real are never merged: their counts are null and they are nobody's history. An event without a time has no history
    (0) and is part of none. A null kind of an earlier event is a kind of its own; of the event itself, it makes the number null.
    """
    us, real, prior = unused(events, "_us", "_real", "_prior")
    w = Window.partitionBy(author, real).orderBy(us).rangeBetween(Window.unboundedPreceding, -1)
    timed = F.col(us).isNotNull() & F.col(real)
    out = events.withColumns({us: F.unix_micros(F.col(ts).cast("timestamp")), real: F.coalesce(real_author(F.col(author).cast("string")), F.lit(False))})
    held = lambda c: F.when(F.col(real), F.when(F.col(us).isNotNull(), c).otherwise(0))
    seen = F.struct(F.collect_set(F.when(timed, F.col(kind_col))).over(w).alias("kinds"), F.max(F.when(timed, F.col(kind_col).isNull())).over(w).alias("none"))
    out = out.withColumns({name: held(F.count(F.when(timed & (F.col(kind_col) == value), 1)).over(w)) for name, value in kinds.items()} | {prior: seen})
    before = F.when(F.col(us).isNotNull(), F.col(f"{prior}.kinds")).otherwise(F.array().cast("array<string>"))
    none = F.when(F.col(us).isNotNull() & F.col(f"{prior}.none"), 1).otherwise(0)
    number = F.size(F.array_union(before, F.array(F.col(kind_col).cast("string")))) + none
    return out.withColumn("kinds_so_far", F.when(F.col(real) & F.col(kind_col).isNotNull(), number).cast("long")).drop(us, real, prior)
