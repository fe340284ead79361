"""The further tables of an export: comments, series links, keyword hits, codebook, field availability and run coverage. Columns that a source lacks are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import contracts, review_table

# fixed values of the export contract
COMMENTS = {"comment_id": "typed_id", "thread_id": "thread_id", "parent_id": "parent_id", "body": "body", "author": "author", "created_utc": "created_utc", "source": "source", "permalink": "canonical_permalink"}
LINKS = ("link_id", "source_thread", "target_thread", "relationship", "supported", "source_record_id", "quote", "review_status")
COVERAGE = {"stage": "stage", "shard": "path", "status": "status", "records_returned": "scanned", "seconds": "elapsed_seconds", "payload_bytes": "payload_bytes", "peak_rss_bytes": "peak_rss_bytes", "scope": "scope", "target_hash": "target_hash", "error": "error"}
CODES = {"post_intent": contracts.INTENTS, "evidence_type": contracts.EVIDENCE_TYPES, "outcome": contracts.OUTCOMES, "relationship": contracts.RELATIONSHIPS, "relationship_subtype": contracts.SUBTYPES, "preservation": contracts.PRESERVATION_TYPES, "confirmation": contracts.CONFIRMATION}
INTENT_AUTHORITY = "Post-intent categories adapted from Kang/Brown/Kiesler 2013, Table 1, DOI 10.1145/2470654.2481368; operational definitions in codebook.md"
AUTHORITY, DEFINITION = "User-supplied project rubric; operational rules in codebook.md", "See codebook.md for evidence and missingness rules"
EXTRA, DERIVED, DIRECT, UNAVAILABLE, OWN = "extra evidence required", "derived", "direct archive field / may be missing", "unavailable in inspected schema; null", "project-derived"


def _columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(h) for h, c in wanted.items()])


def comments_table(records: DataFrame) -> DataFrame:
    return _columns(records.where("kind = 'comments'"), COMMENTS)


def links_table(links: DataFrame) -> DataFrame:
    return _columns(links, {c: c for c in LINKS})


def hits_table(hits: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row for each hit with query_memberships: all sheets and rows that the phrase is from (bounded by the phrase catalog), joined in order; '' for a phrase that is no longer there.

    hits: hit_id, typed_id, thread_id, query_id, field, start, end, quote, context, source; phrases: query_id, sheet, row."""
    origin = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("sheet", "row"))), lambda o: F.concat_ws("!", o["sheet"], o["row"].cast("string"))), "; ")
    names = {"hit_id": "hit_id", "record_id": "typed_id", "thread_id": "thread_id", "query_id": "query_id", "field": "field", "raw_start": "start", "raw_end": "end", "exact_match": "quote", "context": "context", "query_memberships": "query_memberships", "source": "source"}
    rows = hits.join(phrases.groupBy("query_id").agg(origin.alias("query_memberships")), "query_id", "left").fillna("", ["query_memberships"])
    return _columns(rows, names)


def codebook_table(spark: SparkSession) -> DataFrame:
    """field, allowed_label, authority, definition, in the order of the codebook (place)."""
    rows = [(i, field, label, INTENT_AUTHORITY if field == "post_intent" else AUTHORITY, review_table.INTENT_DEFINITIONS.get(label, DEFINITION) if field == "post_intent" else DEFINITION) for i, (field, label) in enumerate((f, x) for f, labels in CODES.items() for x in labels)]
    return spark.createDataFrame(rows, "place int, field string, allowed_label string, authority string, definition string")


def availability_table(spark: SparkSession, filled: DataFrame | None = None) -> DataFrame:
    """export_column, canonical_field, availability of every column of the review table (place), and of a table of cells (review_table.unpivoted) how many are filled."""
    def kind(i: int, header: str, path: str) -> str:
        if i >= 42:
            return OWN
        if path.startswith("metrics.") or header in ("is_self", "upvote_ratio"):
            return UNAVAILABLE
        return EXTRA if path.lstrip("=").startswith(("account.", "evidence", "actors.", "discovery.", "chain", "outcomes", "preservation", "series")) else DIRECT

    rows = [(i, h, p.partition("|")[0], kind(i, h, p)) for i, (h, p) in enumerate(review_table.COLUMNS)]
    out = spark.createDataFrame(rows, "place int, export_column string, canonical_field string, availability string")
    if filled is None:
        return out.withColumn("filled", F.lit(None).cast("long"))
    n = filled.where("value <> ''").groupBy(F.col("header").alias("export_column")).agg(F.count("*").alias("filled"))
    return out.join(n, "export_column", "left").fillna(0, ["filled"]).select("place", "export_column", "canonical_field", "availability", "filled")


def run_coverage_table(checkpoints: DataFrame) -> DataFrame:
    return _columns(checkpoints, COVERAGE)
