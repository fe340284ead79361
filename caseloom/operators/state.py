"""Idempotent state: upserts by version, resume keys, current view of superseding events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, seq: str, keep: str) -> DataFrame:
    """keep 'last' replaces by the highest seq, 'first' ignores all but the lowest; ties go by the whole row."""
    order = [F.col(seq).desc() if keep == "last" else F.col(seq).asc(), *[F.col(c) for c in rows.columns if c not in (key, seq)]]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def resume_key(*parts: Column) -> Column:
    """SHA-256 of a JSON array of strings and nulls; changes whenever a part does."""
    escaped = [F.coalesce(F.concat(F.lit('"'), F.regexp_replace(p.cast("string"), r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null")) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *escaped), F.lit("]")), 256)


def current_view(events: DataFrame) -> DataFrame:
    """(record_id, decision_type, decision, state): heads are events that none supersedes; one head decides, several stay pending."""
    gone = events.where("supersedes_event_id IS NOT NULL").select(F.col("supersedes_event_id").alias("event_id")).distinct()
    heads = events.join(gone, "event_id", "left_anti").groupBy("record_id", "decision_type").agg(F.count("*").alias("n"), F.min("decision").alias("d"))
    return heads.select("record_id", "decision_type", F.when(F.col("n") == 1, F.col("d")).alias("decision"), F.when(F.col("n") == 1, "decided").otherwise("pending").alias("state"))
