"""Review decisions into annotations: quotes located in their sources, support checked group by group, nothing guessed.

A decision that breaks a rule is reported with its reasons and not converted. All that is built for one decision is bounded by the decision itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators import contracts
from caseloom.operators.annotations import PENDING_REASONS, place_quotes
from caseloom.operators.contracts import GROUPS, bound

# fixed values of the annotation contract
REVIEWED = "model_reviewed_available_text_needs_human_review"
STATUS_BASIS = "Current accessibility not checked; archive availability is separate"
LOST_ORIGINAL = "Earlier original referenced but not identified/retrieved"
UNSUPPORTED = "Available text reviewed; unsupported values remain unknown"
NO_COMMENTS = "All thread comments have not been established as collected"
PRESERVED = "Model-reported preservation; human adjudication pending"
SCOPE = "Full title, body and every retained comment supplied without truncation; missing comments and originals remain unresolved"
NOT_PRESERVED = ("unknown", "none observed")

EVIDENCE = contracts.EVIDENCE.simpleString()


def _strings() -> Column:
    return F.array().cast("array<string>")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def post_struct(held: Column, values: dict[str, Column]) -> Column:
    """A post's properties with every field of the contract; values of the archive where `held`, else what is said of an unknown post."""
    rest = {"status": F.lit("Unknown"), "status_basis": F.lit(STATUS_BASIS), "archive_text_availability": F.lit("missing"), "primary_intent": F.lit("Unclear"), "secondary_intents": _strings(), "evidence_refs": _strings()}
    one = lambda f: F.coalesce(F.when(held, values[f.name]), rest.get(f.name, _null(f.dataType.simpleString()))) if f.name in values else rest.get(f.name, _null(f.dataType.simpleString()))
    return F.struct(*[one(f).alias(f.name) for f in contracts.POST.fields])


def located_evidence(decisions: DataFrame, texts: DataFrame) -> DataFrame:
    """(incident_id, evidence, supports, bad): each decision's quotes in order with their exact place, author and time from the source, the groups of each, and how many are not exact.

    decisions: incident_id, d (contracts.DECISION); texts: record_id, field, text, thread_id, author, created_utc, edit_timestamp, permalink. A quote of a record that the decision did not review is not exact."""
    q = decisions.select("incident_id", F.posexplode("d.evidence").alias("pos", "e"), F.col("d.reviewed_record_ids").alias("reviewed")).select("incident_id", "pos", "reviewed", "e.*")
    found = place_quotes(q, texts.select("record_id", "field", "text"))
    about = texts.select("record_id", "field", "thread_id", "author", "created_utc", "edit_timestamp", "permalink")
    found = found.join(about, ["record_id", "field"], "left").withColumn("problem", F.when(~F.array_contains("reviewed", F.col("record_id")), "not_reviewed").otherwise(F.col("problem")))
    values = {
        "evidence_id": F.concat(F.lit("e"), F.col("pos") + 1), "quote": F.col("quote"), "raw_start": F.col("raw_start").cast("long"), "raw_end": F.col("raw_end").cast("long"), "source_record_id": F.col("record_id"), "thread_id": F.col("thread_id"), "permalink": F.col("permalink"),
        "source_field": F.col("field"), "reporting_username": F.col("author"), "role_relative_to_original_op": F.col("role_relative_to_original_op"), "record_created_utc": F.col("created_utc").cast("long"), "edit_timestamp": F.col("edit_timestamp").cast("long"),
        "event_time_expression": F.col("event_time_expression"), "content_type": F.col("content_type"), "attribution": F.col("attribution"),
    }
    one = F.struct(*[values[f.name].alias(f.name) for f in contracts.EVIDENCE.fields])
    per = found.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("pos", one.alias("e"), "supports"))).alias("x"), F.count_if(F.col("problem").isNotNull()).alias("bad"))  # the decision's own quotes
    return per.select("incident_id", F.transform("x", lambda x: x["e"]).alias("evidence"), F.transform("x", lambda x: x["supports"]).alias("supports"), "bad")


def group_refs(evidence: Column, supports: Column) -> Column:
    """Inverted index: map of each supported group to the ids of the evidence that supports it, in order."""
    ids = lambda g: F.transform(F.filter(F.arrays_zip(evidence.alias("e"), supports.alias("s")), lambda x: F.array_contains(x["s"], g)), lambda x: x["e"]["evidence_id"])
    return F.map_from_entries(F.filter(F.transform(F.array(*[F.lit(g) for g in GROUPS]), lambda g: F.struct(g.alias("group"), ids(g).alias("ids"))), lambda x: F.size(x["ids"]) > 0))


def _other(values: Column, unknown: str) -> Column:
    return F.exists(values, lambda x: x != unknown)


def prepared(decisions: DataFrame, bundles: DataFrame, texts: DataFrame) -> DataFrame:
    """decisions beside their bundles with evidence, refs (group -> ids) and problems."""
    twice = decisions.groupBy("incident_id").agg((F.count("*") > 1).alias("twice"))
    rows = decisions.join(twice, "incident_id").join(bundles.withColumn("known", F.lit(True)), "incident_id", "left").join(located_evidence(decisions.dropDuplicates(["incident_id"]), texts), "incident_id", "left")
    rows = rows.withColumns({"evidence": F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")), "supports": F.coalesce("supports", F.array().cast("array<array<string>>"))})
    d, refs = F.col("d"), group_refs(F.col("evidence"), F.col("supports"))
    # an author's own statement in the original record speaks for its author, even where no group is named
    plain = (d["reporters"] == F.array(F.lit("OP/author"))) & (d["relationship"] == "Unclear") & ~_other(d["finders"], "Unclear") & ~_other(d["relationship_subtypes"], "unclear") & d["target_is_containing_thread_op"].isNull()
    own = F.transform(F.filter("evidence", lambda e: (e["source_record_id"] == F.col("original_post_id")) & (e["attribution"] == contracts.ATTRIBUTION[0])), lambda e: e["evidence_id"])
    rows = rows.withColumn("refs", refs).withColumn("own", own)
    extra = F.when(~F.map_contains_key("refs", "actors") & plain & (F.size("own") > 0), F.map_concat("refs", F.create_map(F.lit("actors"), F.col("own")))).otherwise(F.col("refs"))
    rows = rows.withColumn("refs", extra).drop("own")
    said = {
        "qualification": d["label"] == "Yes",
        "intent": (d["intent"] != "Unclear") | (F.size(d["secondary_intents"]) > 0),
        "series": (d["series_status"] != "Unclear") | d["series_supported_total"].isNotNull() | d["series_count_prior_to_reidentification"].isNotNull(),
        "account": (d["account_type"] != "Unclear") | d["declared_throwaway"].isNotNull() | d["declared_one_time_use"].isNotNull() | d["observed_account_reuse"].isNotNull(),
        "actors": (d["relationship"] != "Unclear") | _other(F.concat(d["reporters"], d["finders"]), "Unclear") | d["target_is_containing_thread_op"].isNotNull(),
        "discovery": _other(d["discovery_paths"], "Unclear") | d["found_time_expression"].isNotNull() | d["voluntary_disclosure"].isNotNull(),
        "outcomes": (F.size(d["outcomes"]) > 0) | F.coalesce(d["explicitly_no_repercussions"], F.lit(False)),
        "preservation": F.exists(d["preservation"], lambda p: ~p["type"].isin(*NOT_PRESERVED)),
    }
    n = F.size("evidence")
    held = lambda g: F.coalesce(F.element_at("refs", F.lit(g)), _strings())
    wrong = lambda ix, g: (F.size(ix) == 0) | F.exists(ix, lambda i: (i < 0) | (i >= n)) | (F.size(F.array_except(F.transform(ix, lambda i: F.concat(F.lit("e"), i + 1)), held(g))) > 0)
    problems = {
        "decided_twice": F.col("twice"),
        "unknown_incident": F.col("known").isNull() | (d["incident_id"] != F.col("incident_id")),
        "records_not_covered": F.array_sort(d["reviewed_record_ids"]) != F.array_sort("record_ids"),
        "quote_not_exact": F.coalesce("bad", F.lit(0)) > 0,
        **{f"unsupported: {g}": c & (F.size(held(g)) == 0) for g, c in said.items()},
        "evidence of outcomes": F.exists(d["outcomes"], lambda o: wrong(o["evidence_indexes"], "outcomes")),
        "evidence of preservation": F.exists(d["preservation"], lambda p: ~p["type"].isin(*NOT_PRESERVED) & wrong(p["evidence_indexes"], "preservation")),
        "intent_of_missing_original": d["earlier_original_missing"] & said["intent"],
    }
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in problems.items()])))


def conversion_problems(ready: DataFrame) -> DataFrame:
    """(incident_id, problem) of `prepared` decisions that are not converted."""
    return ready.select("incident_id", F.explode("problems").alias("problem")).distinct()


def converted(ready: DataFrame, method: str) -> DataFrame:
    """Annotations (fields of contracts.ANNOTATION; open ones are maps and structs) of the `prepared` decisions without problems.

    Bundles give record_ids, seed_record_ids, original (post_struct), original_post_id, original_resolution_status, observed_post_ids, content_hash, retrieved_comments, comments_missing_reason."""
    d, lost = F.col("d"), F.col("d.earlier_original_missing")
    refs = lambda g: F.coalesce(F.element_at("refs", F.lit(g)), _strings())
    ids = lambda ix: F.transform(ix, lambda i: F.concat(F.lit("e"), i + 1))
    nothing = post_struct(F.lit(False), {})
    told = {"primary_intent": d["intent"], "secondary_intents": d["secondary_intents"], "evidence_refs": refs("intent")}
    original = F.when(lost, nothing).otherwise(F.struct(*[told.get(f.name, F.col("original")[f.name]).alias(f.name) for f in contracts.POST.fields]))
    or_one = lambda c, v: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(v)))
    struct = lambda **c: F.struct(*[x.alias(k) for k, x in c.items()])
    empty = F.map_from_arrays(_strings(), _strings())
    platforms = F.nullif(F.array_join(d["discovery_platforms"], ", "), F.lit(""))
    step = lambda p: struct(path=p, platform=platforms, order=_null("bigint"), evidence_refs=refs("discovery"))
    outcome = lambda o: struct(label=o["label"], affected_person=o["affected_person"], timing=o["timing"], attributed_to_reidentification=o["attributed_to_reidentification"], evidence_refs=ids(o["evidence_indexes"]))
    kept = lambda p: struct(
        post_id=p["post_id"], type=p["type"], source_record_id=p["source_record_id"], source_url=p["source_url"], attribution=_null("string"), timestamp=_null("bigint"), completeness=p["completeness"], copied_original_metadata=empty,
        evidence_refs=F.when(p["type"].isin(*NOT_PRESERVED), _strings()).otherwise(ids(p["evidence_indexes"])), detection_status=F.lit(PRESERVED),
    )
    reasons = {**{k: F.lit(v) for k, v in PENDING_REASONS.items()}, **{k: F.lit(UNSUPPORTED) for k in ("classification", "actors", "discovery", "outcomes", "post_intent")}, "comments": F.coalesce("comments_missing_reason", F.lit(NO_COMMENTS))}
    missing = F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), v)])
    values = {
        "schema_version": F.lit("1.0"), "incident_id": F.col("incident_id"), "seed_record_ids": F.col("seed_record_ids"), "original": original, "post_properties": F.array(F.col("original")), "original_resolution_status": F.when(lost, "unresolved").otherwise(F.col("original_resolution_status")),
        "confirmed_reidentification": d["label"], "evidence_basis": d["evidence_basis"], "identity_connection_type": d["identity_connection_type"], "voluntary_disclosure": d["voluntary_disclosure"], "rationale": d["rationale"], "review_status": F.lit(REVIEWED),
        "review_coverage": struct(classification_performed=F.lit(True), all_retrieved_text_reviewed=F.lit(True), record_ids=F.col("record_ids"), all_thread_comments_available=F.lit(False), scope=F.lit(SCOPE), independent_verification=F.lit(False)),
        "series": struct(
            status=d["series_status"], observed_post_ids=F.col("observed_post_ids"), observed_count=F.size("observed_post_ids").cast("long"), supported_total_count=d["series_supported_total"], total_estimate_basis=d["series_basis"],
            count_prior_to_reidentification=d["series_count_prior_to_reidentification"], later_update_ids=_strings(), missing_link_ids=_strings(), complete=F.lit(False), evidence_refs=refs("series"),
        ),
        "evidence": F.col("evidence"),
        "actors": struct(
            reporters=or_one(d["reporters"], "Unclear"), finders=or_one(d["finders"], "Unclear"), finder_relationship_requested_category=d["relationship"], finder_relationship_subtypes=or_one(d["relationship_subtypes"], "unclear"), finder_graph_distance_observed=_null("bigint"),
            finder_graph_distance_basis=_null("string"), reporter_finder_distinction=_null("string"), subject_referred_to=_null("string"), target_is_containing_thread_op=d["target_is_containing_thread_op"], evidence_refs=refs("actors"),
        ),
        "discovery": struct(
            chain=F.transform(d["discovery_paths"], step), found_time_start=_null("string"), found_time_end=_null("string"), original_time_expression=d["found_time_expression"], time_precision=_null("string"), time_derivation=_null("string"), notes=d["discovery_notes"],
            claimed_identifying_clues=_strings(), mechanism_basis=F.lit("unclear"), evidence_refs=refs("discovery"),
        ),
        "preservation": F.transform(d["preservation"], kept),
        "account": struct(
            status=F.lit("Unknown"), status_observation_date=_null("string"), requested_type=d["account_type"], declared_throwaway=d["declared_throwaway"], declared_intended_one_time_use=d["declared_one_time_use"], observed_reuse=d["observed_account_reuse"], observed_activity_counts=empty,
            observation_window=empty, perceived_protection_statement=_null("string"), perceived_protection_change=_null("string"), author_discovery_explanation=_null("string"), evidence_refs=refs("account"),
        ),
        "outcomes": F.transform(d["outcomes"], outcome), "no_outcome_reported": d["no_outcome_reported"], "explicitly_no_repercussions": d["explicitly_no_repercussions"],
        "metrics": F.map_from_arrays(_strings(), F.array().cast("array<bigint>")), "missingness": F.when(lost, F.map_concat(missing, F.create_map(F.lit("original_post"), F.lit(LOST_ORIGINAL)))).otherwise(missing), "claim_evidence": F.col("refs"),
        "collection_coverage": struct(retrieved_comments=F.col("retrieved_comments"), comments_missing_reason=F.col("comments_missing_reason")),
        "additional_incidents": F.transform(d["additional_incident_notes"], lambda n: struct(review_note=n, requires_separate_adjudication=F.lit(True))),
        "annotation_provenance": struct(method=F.lit(method), case_content_hash=F.col("content_hash")),
    }
    return ready.where(F.size("problems") == 0).select(*[values[f.name].alias(f.name) for f in contracts.ANNOTATION.fields])


def contract_faults(annotations: DataFrame) -> DataFrame:
    """(incident_id, path, fault) of annotations against the closed-world contract, through their JSON."""
    text = F.to_json(F.struct(*annotations.columns), {"ignoreNullFields": "false"})
    return annotations.select("incident_id", F.explode(contracts.faults(text, contracts.ANNOTATION)).alias("x")).select("incident_id", "x.*")


def dangling_refs(annotations: DataFrame) -> DataFrame:
    """(incident_id, ref): evidence that some part of an annotation names and the annotation lacks."""
    return annotations.select("incident_id", F.explode(bound(F.struct(*annotations.columns), contracts.unknown_refs)).alias("ref"))
