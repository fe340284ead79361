"""The review table: one row for each annotation and seed, every column compiled from a path into one select.

A path names a root (seed and original_record are records, anything else a part of the annotation) and steps into it: `.name` of a struct or map, `[]` for each element of an array, `[a:b]` for a
slice of a text in code points; two paths may be added. What a path gives is rendered as a cell: texts and numbers as they are, several values joined, nested values as JSON.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.exports import last_seed

_STEP = re.compile(r"\.?([a-z_][a-z_0-9]*)|(\[\])|\[(\d+):(\d+)\]")


def compile_path(path: str, roots: dict[str, tuple[Column, T.DataType]]) -> tuple[Column, T.DataType]:
    """The Column of a path and its type. roots: name -> (Column, type). A step that the type does not have is an error; a map lacks nothing."""
    if " + " in path:
        (a, kind), (b, _) = (compile_path(p, roots) for p in path.split(" + ", 1))
        return a + b, kind
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"path {path!r} ends at {at}")
        steps.append(m.groups())
        at = m.end()
    col, kind = roots[steps[0][0]]
    return _along(col, kind, steps[1:], path)


def _along(col: Column, kind: T.DataType, steps: list[tuple], path: str) -> tuple[Column, T.DataType]:
    for i, (name, each, a, b) in enumerate(steps):
        if each:
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"{path!r}: no array at step {i + 1}")
            rest = steps[i + 1 :]
            inner = _along(F.lit(None), kind.elementType, rest, path)[1]
            return F.transform(col, _each(kind.elementType, rest, path)), T.ArrayType(inner)
        if a is not None:
            col = F.substring(col, F.lit(int(a) + 1), F.lit(int(b) - int(a)))
        elif isinstance(kind, T.MapType):
            col, kind = col[name], kind.valueType
        elif isinstance(kind, T.StructType) and name in kind.names:
            col, kind = col[name], kind[name].dataType
        else:
            raise ValueError(f"{path!r}: no {name!r}")
    return col, kind


def _each(kind: T.DataType, steps: list[tuple], path: str) -> Callable[[Column], Column]:
    return lambda x: _along(x, kind, steps, path)[0]


def utc_date(seconds: Column) -> Column:
    """The instant in ISO form; null for null."""
    return F.when(seconds.isNotNull(), F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def joined(values: Column, by: str = "; ") -> Column:
    """Values that are not null, joined; '' for none."""
    return F.coalesce(F.array_join(F.transform(values, lambda v: v.cast("string")), by), F.lit(""))


def _with(x: Column, first: str, second: str) -> Column:
    return F.concat(x[first], F.when(F.coalesce(x[second], F.lit("")) != "", F.concat(F.lit(": "), x[second])).otherwise(""))


def _or_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))


# fixed values of the export contract
INTENT_DEFINITIONS = {
    "Browsing and searching for information": "Explicit information-seeking/browsing behavior; posting alone does not establish browsing.",
    "Filesharing and downloading": "Sharing or obtaining downloadable files is the principal purpose.",
    "Participating in special interest groups": "Participation around a hobby or shared topic, distinct from a specific support request.",
    "Social networking": "Building or maintaining interpersonal contact.",
    "Sharing art and/or work": "Presenting authored creative or professional output, including feedback requests.",
    "Exchanging help or support": "Requesting or providing advice, practical help, emotional or peer support.",
    "Buying and/or selling": "A transaction or solicitation to transact.",
    "Discussing politics or news": "Political discussion; news is a project extension.",
    "Reviewing and/or recommending": "Evaluating or recommending a product, service or experience.",
    "Unclear": "Insufficient or conflicting evidence to establish the original post purpose.",
}
NO_OUTCOME, QUALIFY = "No outcome reported in available text", "Keyword candidate; qualification pending"
# header -> path, or =formula of FORMULAS, or path|way of rendering
COLUMNS = [
    ("id", "seed.id"), ("permalink", "seed.canonical_permalink"), ("title", "seed.title"), ("Confirmed URL", "evidence[].permalink|first"), ("Account age (@ time of posting)", "metrics.account_age_seconds"),
    ("# of other comments (@ time of posting)", "metrics.prior_comments_lifetime"), ("# of other posts (@ time of posting)", "metrics.prior_posts_lifetime"),
    ("# subreddits active in (@ time of posting, including original subreddit)", "metrics.distinct_active_subreddits_lifetime"), ("Throwaway/One time Use", "account.requested_type"), ("Deleted Account?", "account.status"),
    ("Weekly Visitors (Lurkers) at posting", "metrics.weekly_visitors_at_posting"), ("Weekly Contributors (Posters) at posting", "metrics.weekly_contributors_at_posting"), ("Upvote/downvote counts", "metrics.upvotes + metrics.downvotes"),
    ("Comments exposure metric", "original_record.num_comments"), ("Traffic exposure metric", "metrics.traffic_at_posting"), ("Deleted Post?", "original.status"), ("Post Intent", "original.primary_intent"), ("url", "original_record.url"), ("Post ID", "original.post_id"),
    ("OG post date", "original.created_utc|date"), ("OG Reddit", "original.subreddit"), ("OG Post Title", "original.title"), ("OP POST", "original.full_text[0:14000]|text"), ("OP Post Part 2 (if needed)", "original.full_text[14000:28000]|part"),
    ("RELEVANT COMMENTS WHERE RE-IDENTIFICATION OCCURRED", "evidence[].quote|paragraphs"), ("Who is reporting re-identification?", "actors.reporters|joined"), ("When was it found?", "discovery.original_time_expression"), ("How was it found?", "=chain"),
    ("Who found it originally?", "actors.finders|joined"), ("Notes related to discovery", "discovery.notes"), ("Part of a series? Total # of posts, updates/linked posts prior to re-identification", "=series"), ("Repercussions/outcomes", "=outcomes"),
    ("Where was deleted post preserved", "=preservation"), ("author", "original_record.author"), ("score", "original_record.score"), ("upvote_ratio", "original_record.upvote_ratio"), ("num_comments", "original_record.num_comments"), ("created_utc", "original.created_utc"),
    ("link_flair_text", "original_record.link_flair_text"), ("is_self", "original_record.is_self"), ("over_18", "original_record.over_18"), ("selftext", "original.full_text|text"),
    ("Confirmed re-identification", "confirmed_reidentification"), ("Review status", "review_status"), ("Incident ID", "incident_id"), ("Original resolution status", "original_resolution_status"), ("Evidence type", "evidence[].content_type"),
    ("Finder relationship requested category", "actors.finder_relationship_requested_category"), ("Finder graph distance observed", "actors.finder_graph_distance_observed"), ("Finder relationship subtypes", "actors.finder_relationship_subtypes"),
    ("Evidence references", "evidence[].evidence_id"), ("Account observation date", "account.status_observation_date"), ("Post observation date", "original.status_observed_at"), ("Missingness reasons", "missingness"), ("Collection coverage", "collection_coverage"),
    ("Review coverage", "review_coverage"), ("Identity connection type", "identity_connection_type"), ("Voluntary disclosure", "voluntary_disclosure"), ("Canonical case file", "=case_file"), ("Annotation file", "=annotation_file"), ("Triage flags", "seed.triage_flags"),
    ("Candidate disposition", "=disposition"), ("Reviewer label", "edit.label"), ("Reviewer notes", "edit.notes"), ("Full annotation JSON", "=annotation"),
    ("Decision rationale", "rationale"), ("Post intent definition", "=intent"), ("Seed subreddit", "seed.subreddit"), ("Post status basis", "original.status_basis"), ("Archived post text availability", "original.archive_text_availability"),
    ("Evidence reporting usernames", "evidence[].reporting_username|joined"), ("Evidence reporting timestamps UTC", "evidence[].record_created_utc|dates"), ("Evidence source fields", "evidence[].source_field|joined"),
    ("Evidence roles", "evidence[].role_relative_to_original_op|joined"), ("Series status", "series.status"), ("Supported series total", "series.supported_total_count"), ("Posts before re-identification", "series.count_prior_to_reidentification"),
    ("Observed posts in bundle", "series.observed_count"), ("Outcome labels", "outcomes[].label|joined"), ("Preservation types", "preservation[].type|joined"), ("Preservation source URLs", "preservation[].source_url|joined"),
    ("Retained comment count", "collection_coverage.retrieved_comments"), ("All thread comments available", "review_coverage.all_thread_comments_available|false"), ("Comments missing reason", "collection_coverage.comments_missing_reason"),
    ("Model review provenance", "annotation_provenance.method"),
]
FORMULAS: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "chain": lambda a: joined(F.transform(a("discovery.chain"), lambda s: _with(s, "path", "platform"))),
    "series": lambda a: F.concat(a("series.status"), F.lit("; supported total: "), _or_unknown(a("series.supported_total_count")), F.lit("; pre-discovery: "), _or_unknown(a("series.count_prior_to_reidentification"))),
    "outcomes": lambda a: F.coalesce(F.nullif(joined(a("outcomes[].label")), F.lit("")), F.when(F.coalesce(a("no_outcome_reported"), F.lit(False)), NO_OUTCOME).otherwise("Unclear")),
    "preservation": lambda a: joined(F.transform(a("preservation"), lambda p: _with(p, "type", "source_url"))),
    "case_file": lambda a: F.concat(F.lit("cases/"), a("incident_id"), F.lit(".json")),
    "annotation_file": lambda a: F.concat(F.lit("annotations/"), a("incident_id"), F.lit(".json")),
    "disposition": lambda a: F.when(F.startswith(a("review_status"), F.lit("pending")), QUALIFY).when(a("confirmed_reidentification") == "Yes", "Reported event").otherwise(F.concat(F.lit("Reviewed "), a("confirmed_reidentification"))),
    "annotation": lambda a: F.to_json(a("annotation"), {"ignoreNullFields": "false"}),
    "intent": lambda a: F.element_at(F.create_map(*[F.lit(x) for kv in INTENT_DEFINITIONS.items() for x in kv]), a("original.primary_intent")),
}
WAYS: dict[str, Callable[[Column], Column]] = {
    "first": lambda c: F.get(c, F.lit(0)),
    "date": utc_date,
    "dates": lambda c: joined(F.transform(c, utc_date)),
    "text": lambda c: F.coalesce(c, F.lit("")),
    "part": lambda c: F.nullif(c, F.lit("")),
    "paragraphs": lambda c: joined(c, "\n\n"),
    "joined": joined,
    "false": lambda c: F.coalesce(c, F.lit(False)),
}


def _cell(col: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, T.ArrayType | T.StructType | T.MapType)
    return F.to_json(col, {"ignoreNullFields": "false"}) if nested else col.cast("string")


def review_table(annotations: DataFrame, records: DataFrame, edits: DataFrame | None = None, columns: list[tuple[str, str]] = COLUMNS) -> DataFrame:
    """incident_id, seed_record_id, place (of the seed, from 0) and a string column for each header of COLUMNS.

    annotations: fields of contracts.ANNOTATION; records: typed_id, id, canonical_permalink, title, subreddit, triage_flags, num_comments, url, author, score, upvote_ratio, link_flair_text, is_self, over_18;
    edits: incident_id, label, notes of reviewers. Seeds and originals without a record have empty cells. One join for seeds, one for originals, one select.
    """
    spark, fields = annotations.sparkSession, [f.name for f in annotations.schema.fields]
    edits = spark.createDataFrame([], "incident_id string, label string, notes string") if edits is None else edits
    whole = annotations.select(F.struct(*fields).alias("annotation"), F.posexplode("seed_record_ids").alias("place", "seed_record_id"))
    record = F.struct(*records.columns)
    rows = whole.join(records.select(F.col("typed_id").alias("seed_record_id"), record.alias("seed")), "seed_record_id", "left")
    rows = rows.join(records.select(F.col("typed_id").alias("post"), record.alias("original_record")), F.col("annotation.original.post_id") == F.col("post"), "left")
    rows = rows.join(edits.select(F.col("incident_id").alias("edited"), F.struct("label", "notes").alias("edit")), F.col("annotation.incident_id") == F.col("edited"), "left")
    schema = rows.schema
    roots = {n: (F.col(n), schema[n].dataType) for n in ("seed", "original_record", "edit", "annotation")} | {n: (F.col("annotation")[n], annotations.schema[n].dataType) for n in fields}
    out = []
    for header, what in columns:
        path, _, way = what.partition("|")
        if path.startswith("="):
            out.append(FORMULAS[path[1:]](lambda p: compile_path(p, roots)[0]).cast("string").alias(header))
        else:
            col, kind = compile_path(path, roots)
            out.append((WAYS[way](col).cast("string") if way else _cell(col, kind)).alias(header))
    return rows.select(F.col("annotation.incident_id").alias("incident_id"), "seed_record_id", "place", *out)


def incident_table(table: DataFrame, annotations: DataFrame) -> DataFrame:
    """The review row of each incident's last seed and all its seed ids joined; incidents without seeds have no row."""
    seeds = last_seed(annotations).join(annotations.select("incident_id", joined(F.col("seed_record_ids")).alias("All seed record IDs"), (F.size("seed_record_ids") - 1).alias("last")), "incident_id")
    return table.join(seeds.select("incident_id", F.col("last").alias("place"), "All seed record IDs"), ["incident_id", "place"])


def unpivoted(table: DataFrame, headers: list[str]) -> DataFrame:
    """incident_id, seed_record_id, place, header, value: a row for each cell."""
    cells = F.array(*[F.struct(F.lit(h).alias("header"), F.col(f"`{h}`").alias("value")) for h in headers])
    return table.select("incident_id", "seed_record_id", "place", F.explode(cells).alias("c")).select("incident_id", "seed_record_id", "place", "c.*")
