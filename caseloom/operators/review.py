"""Screening, human review events, final views, evaluation and audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_content(events: DataFrame) -> DataFrame:
    cols = sorted(c for c in events.columns if c != "event_id")
    return events.withColumn("_h", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def import_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events once each, and the ids whose copies differ: those must stop the import."""
    kept = _with_content(events).groupBy("event_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    return events.dropDuplicates(["event_id"]).join(kept.where("lo = hi"), "event_id", "left_semi"), kept.where("lo <> hi").select("event_id")


def conflicting_events(events: DataFrame) -> DataFrame:
    """(event_id, contents): the events whose copies differ, and how many different contents they have."""
    return _with_content(events).groupBy("event_id").agg(F.countDistinct("_h").alias("contents")).where("contents > 1")


def screen(records: DataFrame, exclude: dict[str, Column], doubt: dict[str, Column]) -> DataFrame:
    """records with decision and reasons: clear rules exclude, doubtful ones leave pending, all else is retained.

    Every record stays in the ledger. Age rules must not be among the excluding ones; they only raise doubt.
    """
    if any("age" in name.split("_") for name in exclude):
        raise ValueError("age never excludes by machine")
    pick = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    out = records.withColumns({"_x": pick(exclude), "_d": pick(doubt)})
    decision = F.when(F.size("_d") > 0, "pending").when(F.size("_x") > 0, "excluded").otherwise("retained")
    return out.withColumn("decision", decision).withColumn("reasons", F.concat("_d", "_x")).drop("_x", "_d")


def final_views(candidates: DataFrame, views: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_id, view, reason): a human decision includes or excludes; a model's Yes alone stays pending.

    views: record_id, decision, state of one decision type, as current_view gives them; labels: record_id, label.
    """
    j = candidates.select("record_id").join(views.select("record_id", "decision", "state"), "record_id", "left").join(labels.select("record_id", "label"), "record_id", "left")
    decided = F.col("state") == "decided"
    view = F.when(decided & (F.col("decision") == "Yes"), "included").when(decided & (F.col("decision") == "No"), "excluded").otherwise("pending")
    reason = (
        F.when(decided & F.col("decision").isin("Yes", "No"), "human_decision").when(F.col("state") == "pending", "conflicting_decisions")
        .when(decided, "human_unsure").when(F.col("label") == "Yes", "model_label_only").otherwise("not_reviewed")
    )
    return j.select("record_id", view.alias("view"), reason.alias("reason"))


def split_of(group: Column, seed: str, shares: dict[str, int]) -> Column:
    """The split of a whole group (author or incident), by a hash; shares are in percent."""
    at = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    out, upto = F.lit(None).cast("string"), 100
    for name, share in reversed(shares.items()):
        out = F.when(at < upto, name).otherwise(out)
        upto -= share
    return out


def evaluation(rows: DataFrame) -> DataFrame:
    """Per split: confusion counts, precision and recall of boolean predicted against actual; a metric without cases is null with its reason."""
    p, a = F.col("predicted"), F.col("actual")
    c = rows.groupBy("split").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    rate = lambda n, d: F.when(F.col(n) + F.col(d) > 0, F.round(F.col(n) / (F.col(n) + F.col(d)), 6))
    return c.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")}).withColumn("reason", F.when(F.col("recall").isNull(), "no_positive_labels").when(F.col("precision").isNull(), "no_positive_predictions"))


def audit_sample(population: DataFrame, record: str, stratum: str, per_stratum: int, seed: str) -> DataFrame:
    """(stratum, record, inclusion_probability): the records of smallest seeded hash in each stratum. A bounded top-k for each stratum, combined before the shuffle."""
    h = population.select(stratum, record, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(record).cast("string")), 256).alias("_h"))
    size = h.groupBy(stratum).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(stratum).orderBy("_h", record)
    top = h.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_stratum)
    same = top[stratum].eqNullSafe(size[stratum])
    return top.join(F.broadcast(size) if size.limit(10001).count() <= 10000 else size, same).select(top[stratum], record, F.round(F.least(F.lit(1.0), F.lit(per_stratum) / F.col("_n")), 9).alias("inclusion_probability"))


def population_hash(population: DataFrame, record: str) -> DataFrame:
    """(n, population_hash) of a set of records, whatever their order."""
    part = lambda i: F.sum(F.conv(F.substring("_h", i, 12), 16, 10).cast("decimal(38,0)"))
    s = population.select(F.sha2(F.col(record).cast("string"), 256).alias("_h")).agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"))
    return s.select("n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("population_hash"))
