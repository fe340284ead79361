import copy
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators import contracts, conversion, review_table


def brute_faults(x, kind, null=False, meta=None, path=""):
    """The contract walked in Python."""
    meta = meta or {}
    if x is None:
        return [] if null else [(path, "null")]
    dot = lambda n: f"{path}.{n}" if path else n
    if isinstance(kind, T.StructType):
        if not isinstance(x, dict):
            return [(path, "wrong_type")]
        out = [(dot(k), "unknown_key") for k in x if k not in kind.names] + [(dot(k), "missing_key") for k in kind.names if k not in x]
        return out + [f for k in kind.fields if k.name in x for f in brute_faults(x[k.name], k.dataType, k.nullable, k.metadata, dot(k.name))]
    if isinstance(kind, T.MapType):
        return [f for k, v in x.items() for f in brute_faults(v, kind.valueType, False, meta, f"{path}.{k}")] if isinstance(x, dict) else [(path, "wrong_type")]
    if isinstance(kind, T.ArrayType):
        return [f for i, v in enumerate(x) for f in brute_faults(v, kind.elementType, False, meta, f"{path}[{i}]")] if isinstance(x, list) else [(path, "wrong_type")]
    if meta.get("open"):
        return [] if isinstance(x, dict) else [(path, "wrong_type")]
    want = {T.StringType: str, T.LongType: int, T.BooleanType: bool}[type(kind)]
    if type(x) is not want:
        return [(path, "wrong_type")]
    return [(path, "not_allowed")] if "enum" in meta and x not in meta["enum"] else []


def sample(kind, meta, rng):
    if isinstance(kind, T.StructType):
        return {f.name: None if f.nullable and rng.random() < 0.5 else sample(f.dataType, f.metadata, rng) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return {"k": sample(kind.valueType, meta, rng)}
    if isinstance(kind, T.ArrayType):
        return [sample(kind.elementType, meta, rng) for _ in range(rng.randrange(3))]
    if meta.get("open"):
        return {"anything": [1, None]}
    return rng.choice(meta["enum"]) if "enum" in meta else {T.StringType: "é😀", T.LongType: 7, T.BooleanType: True}[type(kind)]


def spoil(x, rng):
    """One change somewhere in a JSON value."""
    spots = []

    def walk(v):
        for k, w in v.items() if isinstance(v, dict) else enumerate(v):
            spots.append((v, k))
            if isinstance(w, dict | list):
                walk(w)

    walk(x)
    v, k = rng.choice(spots)
    if isinstance(v, dict) and rng.random() < 0.4:
        v.pop(k) if rng.random() < 0.5 else v.update({f"new {k}": 1})
    else:
        v[k] = rng.choice([None, 1, 1.5, "x", True, [], {}, [None], ["x"], {"a": 1}])


@pytest.mark.parametrize("name", ["DECISION", "ANNOTATION"])
def test_faults_equal_a_walk_in_python(spark, name):
    schema, rng = getattr(contracts, name), random.Random(7)
    values = [sample(schema, {}, rng) for _ in range(20)]
    assert not any(brute_faults(v, schema) for v in values)
    for v in values[5:]:
        for _ in range(rng.randrange(1, 4)):
            spoil(v, rng)
    texts = [json.dumps(v, ensure_ascii=False) for v in values] + ["", "{", "null", "[]", '"x"', None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", contracts.faults(F.col("j"), schema).alias("f")).collect()
    for r in got:
        try:
            x = json.loads(texts[r["i"]] or "{")
        except ValueError:
            assert [tuple(f) for f in r["f"]] == [("", "not_json")]
            continue
        assert sorted(tuple(f) for f in r["f"]) == sorted(brute_faults(x, schema)), texts[r["i"]]


def test_strict_schema_requires_all_and_allows_no_more():
    s = contracts.json_schema(contracts.DECISION)

    def walk(v):
        if isinstance(v, dict):
            if v.get("type") == "object" and "properties" in v:
                assert v["required"] == list(v["properties"]) and v["additionalProperties"] is False
            for w in v.values():
                walk(w)
        elif isinstance(v, list):
            for w in v:
                walk(w)

    walk(s)
    assert len(s["properties"]) == 33 and s["properties"]["voluntary_disclosure"] == {"anyOf": [{"type": "boolean"}, {"type": "null"}]}
    assert len(contracts.ANNOTATION.fields) == 28


def decision(**more):
    quote = {"record_id": "t3_a", "field": "selftext", "quote": "😀 found me", "supports": ["qualification"], "content_type": "Unclear", "role_relative_to_original_op": "OP", "attribution": "author's own statement", "event_time_expression": None}
    out = {"incident_id": "i1", "reviewed_record_ids": ["t3_a", "t1_b"], "label": "Yes", "rationale": "r", "earlier_original_missing": False, "intent": "Unclear", "evidence": [quote], "relationship": "Unclear", "reporters": ["OP/author"], "finders": [], "series_status": "Unclear", "account_type": "Unclear"}
    for f in contracts.DECISION.fields:
        out.setdefault(f.name, None if f.nullable else [])
    return copy.deepcopy(out | more)


@pytest.fixture(scope="module")
def case(spark):
    post = {"post_id": F.lit("t3_a"), "full_text": F.lit("He 😀 found me"), "created_utc": F.lit(5)}
    bundles = spark.range(1).select(
        F.lit("i1").alias("incident_id"), F.array(F.lit("t1_b"), F.lit("t3_a")).alias("record_ids"), F.array(F.lit("t3_a")).alias("seed_record_ids"), conversion.post_struct(F.lit(True), post).alias("original"), F.lit("t3_a").alias("original_post_id"),
        F.lit("provisional seed thread").alias("original_resolution_status"), F.array(F.lit("t3_a")).alias("observed_post_ids"), F.lit("h").alias("content_hash"), F.lit(1).cast("long").alias("retrieved_comments"), F.lit("why").alias("comments_missing_reason"),
    )
    texts = spark.createDataFrame([("t3_a", "selftext", "He 😀 found me, 😀 found me", "t3_a", "op", 5, None, "p"), ("t1_b", "body", "yes", "t3_a", "x", None, 9, None), ("t1_c", "body", "other", "t3_c", "x", 1, None, None)], "record_id string, field string, text string, thread_id string, author string, created_utc long, edit_timestamp long, permalink string")

    def run(*ds):
        rows = spark.createDataFrame([(d["incident_id"] if d["incident_id"] != "other" else "i1", json.dumps(d)) for d in ds], "incident_id string, j string")
        ready = conversion.prepared(rows.select("incident_id", contracts.typed(F.col("j"), contracts.DECISION).alias("d")), bundles, texts)
        return {r["problem"] for r in conversion.conversion_problems(ready).collect()}, conversion.converted(ready, "m")

    return run


def test_a_decision_becomes_a_valid_annotation(case):
    problems, a = case(decision())
    assert not problems and not conversion.contract_faults(a).count() and not conversion.dangling_refs(a).count()
    r = a.first()
    e = r["evidence"][0]
    assert (e["raw_start"], e["raw_end"], e["evidence_id"], e["reporting_username"], e["record_created_utc"], e["thread_id"], e["permalink"]) == (3, 13, "e1", "op", 5, "t3_a", "p")
    assert r["claim_evidence"] == {"qualification": ["e1"], "actors": ["e1"]} and r["actors"]["evidence_refs"] == ["e1"] and r["actors"]["finders"] == ["Unclear"]  # the author's own statement
    assert r["missingness"]["comments"] == "why" and r["annotation_provenance"]["case_content_hash"] == "h"


@pytest.mark.parametrize("change, problem", [
    ({"reviewed_record_ids": ["t3_a"]}, "records_not_covered"), ({"reviewed_record_ids": ["t3_a", "t3_a", "t1_b"]}, "records_not_covered"), ({"evidence": []}, "unsupported: qualification"), ({"intent": "Social networking"}, "unsupported: intent"),
    ({"outcomes": [{"label": "Other", "affected_person": None, "timing": None, "attributed_to_reidentification": None, "evidence_indexes": [1]}]}, "evidence of outcomes"),
    ({"outcomes": [{"label": "Other", "affected_person": None, "timing": None, "attributed_to_reidentification": None, "evidence_indexes": []}]}, "evidence of outcomes"),
    ({"earlier_original_missing": True, "secondary_intents": ["Unclear"]}, "intent_of_missing_original"), ({"incident_id": "other"}, "unknown_incident"), ({"incident_id": "i9"}, "unknown_incident"), ({"series_supported_total": 3}, "unsupported: series"),
    ({"voluntary_disclosure": False}, "unsupported: discovery"), ({"explicitly_no_repercussions": True}, "unsupported: outcomes"), ({"finders": ["Other"]}, "unsupported: actors"), ({"declared_throwaway": False}, "unsupported: account"),
])
def test_what_is_not_supported_is_not_converted(case, change, problem):
    problems, a = case(decision(**change))
    assert problem in problems and a.count() == 0


def test_quotes_must_be_exact_and_decisions_single(case):
    for record, field, quote in (("t3_a", "selftext", "Found me"), ("t3_a", "body", "x"), ("t1_c", "body", "other"), ("t3_a", "selftext", "")):
        d = decision()
        d["evidence"][0].update(record_id=record, field=field, quote=quote)
        assert "quote_not_exact" in case(d)[0]
    problems, a = case(decision(), decision(label="No"))
    assert "decided_twice" in problems and a.count() == 0
    lost = case(decision(earlier_original_missing=True))[1].first()
    assert lost["original"]["post_id"] is None and lost["original_resolution_status"] == "unresolved" and "original_post" in lost["missingness"]


def test_claims_and_references_must_name_evidence(case, spark):
    a = case(decision())[1].withColumn("claim_evidence", F.create_map(F.lit("qualification"), F.array(F.lit("e1")), F.lit("x"), F.array().cast("array<string>"), F.lit("y"), F.array(F.lit("e9"))))
    a = a.withColumn("discovery", F.col("discovery").withField("chain", F.transform(F.array(F.lit(1)), lambda _: F.struct(F.lit("Other").alias("path"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("long").alias("order"), F.array(F.lit("e7")).alias("evidence_refs")))))
    assert sorted(r["ref"] for r in conversion.dangling_refs(a).collect()) == ["claim:x", "claim:y", "e7"]


def test_paths_compile_or_say_why_not(case, spark):
    a = case(decision())[1]
    roots = {n: (F.col(n), a.schema[n].dataType) for n in a.columns}
    show = lambda p: a.select(review_table.compile_path(p, roots)[0].alias("x")).first()["x"]
    assert show("original.full_text[3:7]") == "😀 fo" [:4] and show("evidence[].quote") == ["😀 found me"] and show("metrics.upvotes + metrics.downvotes") is None and show("missingness.comments") == "why"
    for bad in ("original.nothing", "rationale[].x", "original..x", "evidence[]quote!"):
        with pytest.raises(ValueError):
            review_table.compile_path(bad, roots)
    assert len(review_table.COLUMNS) == 85 and len({h for h, _ in review_table.COLUMNS}) == 85


def test_review_table_of_odd_rows(case, spark):
    a = case(decision())[1].withColumn("seed_record_ids", F.array(F.lit("t3_a"), F.lit("gone"), F.lit("t3_a")))
    records = spark.createDataFrame([("t3_a", "a", None, "=T", "s", None, 3, None, "op", 1, None, None, None, True, "clash")], "typed_id string, id string, canonical_permalink string, title string, subreddit string, triage_flags array<string>, num_comments long, url string, author string, score long, upvote_ratio double, link_flair_text string, is_self boolean, over_18 boolean, place string")
    rows = review_table.review_table(a, records).orderBy("place").collect()
    assert [(r["place"], r["id"], r["title"], r["author"]) for r in rows] == [(0, "a", "=T", "op"), (1, None, None, "op"), (2, "a", "=T", "op")]
    assert json.loads(rows[0]["Full annotation JSON"])["evidence"][0]["quote"] == "😀 found me" and rows[0]["OG post date"] == "1970-01-01T00:00:05+00:00" and rows[0]["Candidate disposition"] == "Reported event"
    last = review_table.incident_table(review_table.review_table(a, records), a).collect()
    assert len(last) == 1 and last[0]["place"] == 2 and last[0]["All seed record IDs"] == "t3_a; gone; t3_a"
    assert review_table.review_table(a.where("false"), records).count() == 0 and review_table.review_table(a.withColumn("seed_record_ids", F.array().cast("array<string>")), records).count() == 0
