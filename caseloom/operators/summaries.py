"""Counts over records, hits, phrases, checkpoints, labels and shards, each one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ("[deleted]", "[removed]")
#: the sheet that repeats the phrases of all others
AGGREGATE_SHEET = "All first person searches"


def phrase_groups(phrases: DataFrame) -> DataFrame:
    """(normalized, query_id, origins, first_row, sheets): phrases of one normal form. phrases: sheet, row, normalized.

    Empty phrases are none. The id is 'q_' and 16 digits of the normal form's SHA-256."""
    some = phrases.where("normalized <> ''")
    out = some.groupBy("normalized").agg(F.count("*").alias("origins"), F.min("row").alias("first_row"), F.array_join(F.sort_array(F.collect_set("sheet")), "; ").alias("sheets"))
    return out.withColumn("query_id", query_id(F.col("normalized")))


def query_id(normalized: Column) -> Column:
    return F.concat(F.lit("q_"), F.substring(F.sha2(normalized, 256), 1, 16))


def query_set_hash(groups: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted query ids; the catalog of phrases is what a driver may hold."""
    return groups.agg(F.sha2(F.array_join(F.sort_array(F.collect_set("query_id")), "\n"), 256).alias("query_set_hash"))


def phrase_audit(phrases: DataFrame) -> DataFrame:
    """One row: original, unique and duplicate phrases, and those only in the aggregate sheet or only in the others."""
    some = phrases.where("normalized <> ''")
    each = some.groupBy("normalized").agg(F.count("*").alias("n"), F.bool_or(F.col("sheet") == AGGREGATE_SHEET).alias("all"), F.bool_or(F.col("sheet") != AGGREGATE_SHEET).alias("own"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count("*").alias("uniq"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"),
        F.count_if(F.col("all") & ~F.col("own")).alias("aggregate_only"), F.count_if(F.col("own") & ~F.col("all")).alias("category_only"),
    )


def close_variants(phrases: DataFrame) -> DataFrame:
    """(letters, variants): normal forms that differ in nothing but what is no ASCII letter or digit."""
    forms = phrases.where("normalized <> ''").select("normalized").distinct()
    return forms.groupBy(F.regexp_replace("normalized", "[^a-z0-9]", "").alias("letters")).agg(F.count("*").alias("variants")).where("variants > 1")


def per_value(df: DataFrame, *by: str, **measures: Column) -> DataFrame:
    """n rows for each value of the columns, and other measures."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in measures.items()])


def hit_summary(hits: DataFrame) -> DataFrame:
    """One row: hits, records and threads with hits. hits: typed_id, thread_id."""
    return hits.agg(F.count("*").alias("hits"), F.countDistinct("typed_id").alias("records"), F.countDistinct("thread_id").alias("threads"))


def best_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """(path, key, scanned): of each file the checkpoint that scanned most, of several the first by seq."""
    best = F.min(F.struct((-F.col("scanned")).alias("less"), "seq", "key"))
    return checkpoints.where("scanned IS NOT NULL").groupBy("path").agg(best.alias("b")).select("path", "b.key", (-F.col("b.less")).alias("scanned"))


def text_state(c: Column) -> Column:
    return F.when(c.isNull(), "null").when(c == "", "empty").when(c.isin(*PLACEHOLDERS), "placeholder").otherwise("text")


def text_states(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, state, n): how the text fields are filled."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text_state(F.col(f)).alias("state")) for f in fields])).alias("x")
    return per_value(records.select(pairs).select("x.*"), "field", "state")


def inventory(files: DataFrame) -> DataFrame:
    """(kind, shards, bytes, first_month, last_month, months). files: kind, month, bytes."""
    return files.groupBy("kind").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.countDistinct("month").alias("months"))


def months_of_one_kind(files: DataFrame) -> DataFrame:
    """(month, kind) of months that only one of submissions and comments has."""
    both = files.where(F.col("month").isNotNull() & F.col("kind").isin("submissions", "comments")).groupBy("month").agg(F.min("kind").alias("kind"), F.max("kind").alias("_k"))
    return both.where("kind = _k").drop("_k")


def label_summary(annotations: DataFrame) -> DataFrame:
    """One row: incidents, labels with pending ones apart from Unsure, records and threads. annotations: label, review_status, record_id, thread_id."""
    pending = F.coalesce(F.startswith("review_status", F.lit("pending")), F.lit(True))
    of = lambda v: F.count_if(~pending & (F.col("label") == v))
    return annotations.agg(
        F.count("*").alias("incidents"), of("Yes").alias("yes"), of("No").alias("no"), of("Unsure").alias("unsure"), F.count_if(pending).alias("pending"), F.countDistinct("record_id").alias("records"), F.countDistinct("thread_id").alias("threads"),
    )


def label_counts(annotations: DataFrame) -> DataFrame:
    """(label, review_status, n) from annotations kept as JSON text."""
    return per_value(annotations.select(F.get_json_object("json", "$.label").alias("label"), F.get_json_object("json", "$.review_status").alias("review_status")), "label", "review_status")


def snapshot(files: DataFrame) -> DataFrame:
    """(kind, files, completed, remaining, scanned, candidates), with a row of all kinds whose kind is null.

    files: kind, status, scanned, candidates. Fails where a file has fewer rows than candidates or a complete one has no count."""
    done = F.col("status") == "complete"
    bad = F.coalesce(F.col("candidates") > F.col("scanned"), F.lit(False)) | (done & F.col("scanned").isNull())
    checked = files.withColumn("scanned", F.when(bad, F.raise_error(F.lit("a file's counts do not add up")).cast("long")).otherwise(F.col("scanned")))
    return checked.rollup("kind").agg(
        F.count("*").alias("files"), F.count_if(done).alias("completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("remaining"), F.coalesce(F.sum(F.when(done, F.col("scanned"))), F.lit(0)).alias("scanned"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates")
    )


def deleted_comments(records: DataFrame) -> DataFrame:
    """(thread_id, comments, deleted)."""
    c = records.where("kind = 'comments'")
    return c.groupBy("thread_id").agg(F.count("*").alias("comments"), F.count_if(F.col("body").isin(*PLACEHOLDERS)).alias("deleted"))


def agreement(pairs: DataFrame, by: str, wanted: int) -> DataFrame:
    """(by, cases, agree): agree if there are as many cases as wanted and expected and actual are equal in all."""
    same = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    return pairs.groupBy(by).agg(F.count("*").alias("cases"), (F.bool_and(same) & (F.count("*") == wanted)).alias("agree"))


def hit_id(typed_id: Column, query: Column, field: Column, start: Column, end: Column, revision: str) -> Column:
    """Identity of a match: SHA-256 of its record, phrase, field, span and revision; equal for every scan of the same source."""
    return F.sha2(F.concat_ws("\x1f", typed_id, query, field, start, end, F.lit(revision)), 256)


def counted(files: DataFrame) -> DataFrame:
    """files with searched and whole: a complete unfiltered file counts by its footer, any other by the rows it returned, a lower bound."""
    whole = F.coalesce((F.col("status") == "complete") & ~F.col("filtered"), F.lit(False))
    return files.withColumn("searched", F.when(whole, F.col("footer_rows")).otherwise(F.coalesce("returned_rows", F.lit(0)))).withColumn("whole", whole)


def phrases_per_sheet(phrases: DataFrame) -> DataFrame:
    """(sheet, nonempty_phrases, own): phrases of each sheet that are not empty, and those that no other sheet has."""
    some = phrases.where("normalized <> ''")
    sheets = some.groupBy("normalized").agg(F.countDistinct("sheet").alias("sheets"))
    each = some.join(sheets, "normalized").groupBy("sheet")
    return each.agg(F.count("*").alias("nonempty_phrases"), F.countDistinct(F.when(F.col("sheets") == 1, F.col("normalized"))).alias("own"))


def bytes_by_source(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """(path, payload_bytes): UTF-8 bytes of the text columns read from each source; null texts have none."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return rows.groupBy(F.col(path).alias("path")).agg(F.sum(size.cast("long")).alias("payload_bytes"))


def hits_of_records(hits: DataFrame) -> DataFrame:
    """(typed_id, hit_ids) sorted: the hits of one record, which its text bounds."""
    return hits.groupBy("typed_id").agg(F.sort_array(F.collect_set("hit_id")).alias("hit_ids"))


def retrieval_of(targets: DataFrame, records: DataFrame) -> DataFrame:
    """(thread_id, found, comments) of each target: whether its submission was retrieved and how many of its comments; a target without either has false and 0."""
    own = records.groupBy("thread_id").agg(F.bool_or((F.col("kind") == "submissions") & (F.col("typed_id") == F.col("thread_id"))).alias("found"), F.count_if(F.col("kind") == "comments").alias("comments"))
    return targets.select("thread_id").distinct().join(own, "thread_id", "left").select("thread_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("comments", F.lit(0)).alias("comments"))
