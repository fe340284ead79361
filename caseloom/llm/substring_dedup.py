"""Substring dedup: normalised lines, and the sentences of long lines, hashed in runs and deduplicated over the whole corpus.

A unit ends at a line end or at . ! ? before white space, and is normalised (case folded, white space collapsed).
A run is a unit with as few units before it as make up min_words words; runs are hashed to 128 bits. Of the
runs of one digest the first by (doc_id, text hash, place) stays, and every unit that lies in a later one goes,
spans in original code points. A unit that goes thus has an equal unit of earlier rank in a run like its own, so
of all that repeats one copy stays. Repeats of fewer than min_words words (common lines, short sentences) stay
wherever they stand, and so does a text of fewer.

Text repeated inside a sentence is hashed with its surroundings: a passage spliced into a line keeps its first
and last sentence, and one of a single long sentence is missed.

Digests are grouped with partial aggregation. Only digests that occur twice are joined back to their
occurrences; of those the side with all occurrences is the one that Spark splits where a digest is very
frequent (adaptive skew join), as the other has a single row for each digest.

Edge cases: null and empty texts have no units and stay as they are; rows with the same doc_id and text
are one document and are treated alike; a null doc_id ranks first; other columns pass through, those named like
an added one are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom.llm._common import discard, materialize, small_batches, table

UNIT = re.compile(r"\S(?:[^\n.!?]+|[.!?](?!\s|\Z))*[.!?]*")


def runs(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(place, start, end, digest) of the run that ends with each unit, where there is one."""
    start: list[int] = []
    size: list[int] = []
    mark: list[bytes] = []
    first = n = 0  # of the run
    for i, m in enumerate(UNIT.finditer(text)):
        w = m[0].casefold().split()
        start.append(m.start())
        size.append(len(w))
        mark.append(hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest())
        n += len(w)
        while n - size[first] >= min_words:
            n -= size[first]
            first += 1
        if n >= min_words:
            yield i, start[first], m.start() + len(m[0].rstrip()), hashlib.blake2b(b"".join(mark[first:]), digest_size=16).digest()


def _units(min_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            row, place, spans, digest = [], [], [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                of: dict[bytes, list[int]] = {}
                for i, s, e, d in runs(text or "", min_words):
                    if d not in of:
                        of[d] = []
                        row.append(r)
                        place.append(i)
                        spans.append(of[d])
                        digest.append(d)
                    of[d].append(s << 32 | e)
                if len(row) >= 100_000 or r == batch.num_rows - 1:
                    two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), ids.take(at), batch.column(1).take(at), pa.array(place, pa.int32()), pa.array(spans, pa.list_(pa.int64()))],
                        names=["hi", "lo", "doc_id", "h", "place", "spans"],
                    )
                    row, place, spans, digest = [], [], [], []

    return run


def repeated_runs(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """Runs to remove: doc_id, h (text hash), spans (start << 32 | end, of one digest), kept_doc_id (whose occurrence stays).
    A text's runs of one digest travel as one row, placed where the first is. A written table."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    all_runs = materialize(src.mapInArrow(_units(min_words), "hi long, lo long, doc_id long, h long, place int, spans array<long>"), "runs")
    rank = F.struct("doc_id", "h", "place")
    keep = all_runs.groupBy("hi", "lo").agg(F.min(rank).alias("keep"), F.max(rank).alias("last"), F.max(F.size("spans")).alias("most"))
    keep = keep.where("NOT (keep <=> last) OR most > 1").drop("last", "most")
    gone = F.when(rank.eqNullSafe(F.col("keep")), F.slice("spans", 2, F.size("spans"))).otherwise(F.col("spans"))
    out = all_runs.join(keep, ["hi", "lo"]).withColumn("spans", gone).where("size(spans) > 0").select("doc_id", "h", "spans", F.col("keep.doc_id").alias("kept_doc_id"))
    out = materialize(out, "repeats")
    discard(all_runs)
    return out


def merged(spans: list[int], text: str) -> list[tuple[int, int]]:
    """The spans (start << 32 | end) in order, those that overlap or have only white space between them as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x >> 32, x & 0xFFFFFFFF) for x in spans):
        if out and (s <= out[-1][1] or text[out[-1][1] : s].isspace()):
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans and the white space after each."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
        while at < len(text) and text[at].isspace():
            at += 1
    return "".join([*out, text[at:]])


ADDED = "removed_spans array<struct<start:int,end:int>>, kept_doc_ids array<bigint>, n_removed bigint, removed_chars bigint, clean_text string"


def dedup_substrings(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """docs with removed_spans (of start, end; what goes in one piece is one span), kept_doc_ids, n_removed, removed_chars and clean_text added."""
    gone = repeated_runs(docs, min_words)
    per = gone.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.sort_array(F.collect_set("kept_doc_id")).alias("_kept"))
    per = per.select(F.col("doc_id").alias("_dedup_id"), F.col("h").alias("_dedup_h"), "_spans", "_kept")
    kinds = StructType.fromDDL(ADDED)
    base = docs.drop(*kinds.names)
    names = base.columns
    base = base.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the caller's can clash
    at_id, at_text = names.index("doc_id"), names.index("text")
    on = F.col(f"c{at_id}").cast("long").eqNullSafe(F.col("_dedup_id")) & (F.xxhash64(f"c{at_text}") == F.col("_dedup_h"))
    joined = base.join(per, on, "left").select(*base.columns, "_spans", F.coalesce("_kept", F.array().cast("array<bigint>")))
    schema = StructType([*docs.drop(*kinds.names).schema.fields, *kinds.fields])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            *cols, spans, kept = batch.columns
            texts = cols[at_text].to_pylist()
            cuts = [merged(s, t) if s else [] for s, t in zip(spans.to_pylist(), texts, strict=True)]
            added = [
                pa.array([[{"start": a, "end": b} for a, b in c] for c in cuts], pa.list_(span)),
                kept,
                pa.array([len(c) for c in cuts], pa.int64()),
                pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64()),
                pa.array([cut(t, c) if c else t for t, c in zip(texts, cuts, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*cols, *added], names=schema.names)

    return joined.mapInArrow(run, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document, with its clean text; n_removed is 0 where it is as it was."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", "n_removed", "removed_chars", spans.alias("removed_spans"), "kept_doc_ids", F.col("clean_text").alias("text"))
