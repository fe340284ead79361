"""Annotations: rules over labels and evidence, quotes located in sources, segments and batches, precedence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the annotation contract
LABELS = ("Yes", "No", "Unsure")
OVERLAP = 160

EVIDENCE = "array<struct<evidence_id string, source_record_id string, thread_id string, source_field string, raw_start int, raw_end int, quote string, reporting_username string, record_created_utc bigint>>"
ANNOTATION = f"""incident_id string, content_hash string, label string, review_status string, rationale string, evidence {EVIDENCE},
 evidence_refs array<string>, claim_evidence map<string, array<string>>, relationship_subtypes array<string>, distance int, distance_basis string"""


def violations(annotations: DataFrame) -> DataFrame:
    """(incident_id, rule) for every rule that an annotation breaks. Columns as in ANNOTATION; nulls count as absent."""
    none = F.array().cast("array<string>")
    refs = F.coalesce(F.transform("evidence", lambda e: e["evidence_id"]), none)
    within = lambda c: F.size(F.array_except(F.coalesce(c, none), refs)) == 0
    label, pending = F.coalesce("label", F.lit("Unsure")), F.coalesce(F.startswith("review_status", F.lit("pending")), F.lit(True))
    claims = F.coalesce(F.map_values("claim_evidence"), F.array().cast("array<array<string>>"))
    rules = {
        "unknown_label": ~label.isin(*LABELS),
        "yes_without_evidence": (label == "Yes") & (F.size(refs) == 0),
        "label_before_review": (label != "Unsure") & pending,
        "distance_without_basis": F.array_contains(F.coalesce("relationship_subtypes", none), "stranger") & F.col("distance").isNotNull() & (F.coalesce("distance_basis", F.lit("")) == ""),
        "unknown_evidence": ~within(F.col("evidence_refs")),
        "empty_or_unknown_claim": F.exists(claims, lambda v: (F.coalesce(F.size(v), F.lit(0)) <= 0) | ~within(v)),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return annotations.select("incident_id", F.explode(broken).alias("rule"))


def long_fields(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per record and field: all other columns, field, text. One pass over the input."""
    rest = [c for c in records.columns if c not in fields]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return records.select(*rest, F.explode(pairs).alias("_p")).select(*rest, "_p.field", "_p.text")


def span_violations(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id, rule): the first check that a span fails: record, bounds and text, thread, metadata.

    texts: typed_id, thread_id, author, created_utc, field, text, as long_fields gives them.
    """
    t = texts.select(F.col("typed_id").alias("source_record_id"), F.col("field").alias("source_field"), F.col("thread_id").alias("_thread"), "author", "created_utc", F.coalesce("text", F.lit("")).alias("_t"), F.lit(True).alias("_found"))
    j = evidence.join(t, ["source_record_id", "source_field"], "left")
    a, b = F.col("raw_start"), F.col("raw_end")
    inside = (a >= 0) & (a < b) & (b <= F.length("_t"))
    same = F.substring(F.col("_t"), a + 1, b - a).eqNullSafe(F.col("quote"))
    rule = (
        F.when(F.col("_found").isNull(), "outside_bundle")
        .when(~F.coalesce(inside & same, F.lit(False)), "quote_or_offset")
        .when(~F.col("thread_id").eqNullSafe(F.col("_thread")), "thread")
        .when(~(F.col("record_created_utc").eqNullSafe(F.col("created_utc")) & F.col("reporting_username").eqNullSafe(F.col("author"))), "metadata")
    )
    return j.select("evidence_id", rule.alias("rule")).where("rule IS NOT NULL")


def locate_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes (evidence_id, source_record_id, source_field, quote) with the first exact place, author and time from the source; null where there is none."""
    t = texts.select(F.col("typed_id").alias("source_record_id"), F.col("field").alias("source_field"), "thread_id", F.col("author").alias("reporting_username"), F.col("created_utc").alias("record_created_utc"), "text")
    at = F.when(F.col("quote") != "", F.nullif(F.position(F.col("quote"), F.col("text")), F.lit(0)) - 1)
    return quotes.join(t, ["source_record_id", "source_field"], "left").withColumn("raw_start", at).withColumn("raw_end", F.col("raw_start") + F.length("quote")).drop("text")


def segments(text: Column, size: int, overlap: int = OVERLAP) -> Column:
    """Array of (raw_start, raw_end, text): every character is covered; an empty text has one empty segment."""
    t = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(t), F.lit(1)) - 1, F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("raw_start"), F.least(F.length(t), s + size).alias("raw_end"), F.substring(t, s + 1, F.lit(size)).alias("text")))


def _fold(capacity: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, batch, used, filled = None, 0, 0, False
        for part in parts:
            numbers = []
            for key, size in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if key != case:
                    case, batch, used, filled = key, 0, 0, False
                if filled and used + size > capacity:
                    batch, used = batch + 1, 0
                used, filled = used + size, True
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, pa.int64())], names=["case_id", "place", "size", "batch_id"])

    return run


def batches(sized: DataFrame, capacity: int) -> DataFrame:
    """(case_id, place, size, batch_id): greedy batches in order of place; one opens when the current one holds something and the next would overflow.

    Only ids and sizes move, and a task streams its cases, so a case of any length needs constant memory. An item
    larger than capacity gets a batch of its own: nothing is cut. place: (case_id, place) is unique.
    """
    rows = sized.select(F.col("case_id").cast("string"), F.col("place").cast("long"), F.col("size").cast("long"))
    return rows.repartition("case_id").sortWithinPartitions("case_id", "place").mapInArrow(_fold(capacity), "case_id string, place long, size long, batch_id long")


def oversized(originals: DataFrame, max_chars: int) -> DataFrame:
    """Cases whose original alone takes over half a batch: to be reported, never truncated. originals: case_id, size."""
    return originals.where(F.col("size") > max_chars // 2)


def precedence(bundles: DataFrame, sources: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """For each bundle (incident_id, content_hash) the annotation of the first source that has one for this very content.

    A source has one row per incident and content hash. Bundles without any are pending and Unsure.
    """
    out = bundles
    for name, df in sources:
        out = out.join(df.select("incident_id", "content_hash", F.struct(F.lit(name).alias("annotated_by"), *columns).alias(f"_{name}")), ["incident_id", "content_hash"], "left")
    first = F.coalesce(*[F.col(f"_{n}") for n, _ in sources])
    return out.withColumn("_first", first).select(
        *bundles.columns, F.coalesce("_first.annotated_by", F.lit("pending")).alias("annotated_by"),
        *[F.coalesce(F.col(f"_first.{c}"), F.lit("Unsure")).alias(c) if c == "label" else F.col(f"_first.{c}").alias(c) for c in columns],
    )


def availability(text: Column) -> Column:
    return F.when(text == "[deleted]", "deleted placeholder").when(text == "[removed]", "removed placeholder").when(text.isNull(), "missing").when(text == "", "empty").otherwise("text")


def exact_coverage(supplied: Column, reviewed: Column) -> Column:
    """Whether a review lists exactly the records it was given, each once."""
    return F.array_sort(supplied).eqNullSafe(F.array_sort(reviewed))


def gate(rows: DataFrame, agree: Column, needed: int) -> DataFrame:
    """(cases, agreeing, passed): a model qualifies when all of exactly `needed` reference cases agree."""
    a = F.coalesce(agree, F.lit(False))
    return rows.agg(F.count("*").alias("cases"), F.count_if(a).alias("agreeing")).withColumn("passed", (F.col("cases") == needed) & (F.col("agreeing") == needed))


def all_rules(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


#: why a placeholder's values are unknown; fixed values of the annotation contract
PENDING_REASONS = {
    "historical_account_creation": "not_in_source", "lifetime_history": "not_collected", "weekly_visitors_at_posting": "not_in_source", "weekly_contributors_at_posting": "not_in_source",
    "traffic_at_posting": "not_in_source", "upvotes_downvotes": "not_in_source", "current_account_status": "not_observed", "current_post_status": "not_observed", "is_self": "not_in_source",
    "upvote_ratio": "not_in_source", "actors": "not_reviewed", "discovery": "not_reviewed", "outcomes": "not_reviewed", "post_intent": "not_reviewed",
}


def post_properties(post: str = "") -> Column:
    """Properties of an archived post as a struct; nulls throughout where there is no post. Columns are read under the prefix `post`."""
    c = lambda n: F.col(f"{post}{n}")
    text = c("selftext")
    state = F.when(text == "[deleted]", "deleted placeholder").when(text == "[removed]", "removed placeholder").when(text.isNull(), "missing").when(text == "", "empty").otherwise("text")
    return F.struct(
        c("typed_id").alias("post_id"), c("subreddit").alias("subreddit"), c("canonical_permalink").alias("permalink"), c("title").alias("title"), text.alias("full_text"), c("created_utc").alias("created_utc"),
        F.when(c("typed_id").isNotNull(), state).alias("archive_text_availability"),
    )


def pending_annotations(bundles: DataFrame, posts: DataFrame, reason: str = "model_not_configured") -> DataFrame:
    """A schema-complete placeholder for each bundle: label Unsure, the original's properties, why each unknown is unknown.

    bundles: incident_id, content_hash, original_post_id, original_resolution_status, seed_record_ids, observed_posts (count); posts: as in post_properties.
    """
    p = posts.select(*[F.col(c).alias(f"p_{c}") for c in posts.columns])
    rows = bundles.join(p, F.col("original_post_id") == F.col("p_typed_id"), "left")
    reasons = F.create_map(F.lit("classification"), F.lit(reason), *[F.lit(x) for kv in PENDING_REASONS.items() for x in kv])
    return rows.select(
        "incident_id", "content_hash", "seed_record_ids", post_properties("p_").alias("original"), "original_resolution_status", F.lit("Unsure").alias("label"), F.lit("pending_model_review").alias("review_status"),
        F.array().cast(EVIDENCE).alias("evidence"), F.col("observed_posts").alias("series_observed_count"), F.lit(f"Not classified. {reason}").alias("rationale"), reasons.alias("missingness"),
        F.lit("unclassified schema-complete placeholder").alias("method"),
    )


def place_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes with raw_start, raw_end (code points) of their first occurrence and problem: unknown_record, unknown_field, empty_quote or not_exact.

    quotes: record_id, field, quote and others; texts: record_id, field, text (as long_fields gives them). A quote that is no exact substring is never mended.
    """
    known = texts.select(F.col("record_id"), F.lit(True).alias("_known")).distinct()
    rows = quotes.join(texts, ["record_id", "field"], "left").join(known, "record_id", "left")
    at = F.instr(F.col("text"), F.col("quote"))
    problem = F.when(F.coalesce(F.col("quote"), F.lit("")) == "", "empty_quote").when(F.col("_known").isNull(), "unknown_record").when(F.col("text").isNull(), "unknown_field").when(at == 0, "not_exact")
    return rows.withColumns({"problem": problem, "raw_start": F.when(problem.isNull(), at - 1), "raw_end": F.when(problem.isNull(), at - 1 + F.length("quote"))}).drop("text", "_known")


def review_problems(decisions: DataFrame, bundles: DataFrame, evidence: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(incident_id, problem) of reviews that may not be converted. One row per problem.

    decisions: incident_id, label, reviewed_record_ids, claimed (groups with values), original_intent; bundles: incident_id, record_ids,
    original_missing; evidence: incident_id, supports (groups), problem (of place_quotes). A review covers exactly the records of its bundle, Yes
    has evidence, every claimed group is supported by some evidence of the review, quotes are exact, and intent is Unclear where the original is missing.
    """
    e = evidence.groupBy("incident_id").agg(F.count("*").alias("_n"), F.array_distinct(F.flatten(F.collect_list("supports"))).alias("_supports"), F.count_if(F.col("problem").isNotNull()).alias("_bad"))
    rows = decisions.join(bundles, "incident_id", "left").join(e, "incident_id", "left")
    none = F.array().cast("array<string>")
    held, claimed = F.coalesce("_supports", none), F.array_intersect(F.coalesce("claimed", none), F.array(*[F.lit(g) for g in groups]))
    problems = {
        "unknown_incident": F.col("record_ids").isNull(),
        "records_not_covered": F.col("record_ids").isNotNull() & (F.array_sort(F.coalesce("reviewed_record_ids", none)) != F.array_sort("record_ids")),
        "yes_without_evidence": (F.col("label") == "Yes") & (F.coalesce("_n", F.lit(0)) == 0),
        "quote_not_exact": F.coalesce("_bad", F.lit(0)) > 0,
        "unsupported_group": F.size(F.array_except(claimed, held)) > 0,
        "unknown_group": F.size(F.array_except(F.array_union(held, F.coalesce("claimed", none)), F.array(*[F.lit(g) for g in groups]))) > 0,
        "intent_of_missing_original": F.coalesce("original_missing", F.lit(False)) & ~F.coalesce(F.col("original_intent") == "Unclear", F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in problems.items()]))
    return rows.select("incident_id", F.explode(found).alias("problem"))
