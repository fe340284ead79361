"""A bounded labelled sample for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(n)), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, max_bytes: int) -> tuple[list[tuple[str, int]], float]:
    """Up to per_class (text, label) of each class, in the order of a hash of the id, and the share of label 1.

    Rows of the held-out fold, null ids, labels or texts, empty texts and texts over max_bytes are not used. Of several labels
    (or texts) of one id the smallest counts. The ids are chosen first, at most 2 * per_class of them,
    so only chosen texts leave the scan and documents are not shuffled.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where((fold_of("doc_id", folds) != held_out) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return [], 0.0
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes) & (F.length("text") > 0))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.text", "r.y")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().to_pylist()
    return [(r["text"], r["y"]) for r in got], counts[1] / (counts[0] + counts[1])
