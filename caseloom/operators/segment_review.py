"""Segment by segment review: an annotator sees each segment of a case in order together with its decision so far, and may be asked once more if what it says does not hold.

An annotator is any picklable object with decide(segment, previous, feedback) -> Decision. Models are not part of this library; RuleAnnotator is a deterministic stand-in for tests and dry runs, and its decisions are marked synthetic.
A task streams its cases: it holds one segment and one decision, whatever the length of a case. The streaming form keeps the decision of each case as keyed state between batches and gives the same decisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.annotations import LABELS, segments


@dataclass(frozen=True)
class Decision:
    label: str = "Unsure"
    quote: str | None = None
    raw_start: int | None = None  # in the text that the segment is from
    reviewed: int = 0
    failed: int = 0
    method: str = ""


@dataclass(frozen=True)
class Segment:
    case_id: str
    place: int
    raw_start: int
    text: str


class Annotator(Protocol):
    def decide(self, segment: Segment, previous: Decision, feedback: str | None) -> Decision: ...


@dataclass(frozen=True)
class RuleAnnotator:
    """Yes at the first cue word; nothing is ever No."""

    cues: tuple[str, ...]

    def decide(self, segment: Segment, previous: Decision, feedback: str | None) -> Decision:
        if previous.label == "Yes":
            return previous
        found = min((at, c) for c in (*self.cues, "") if (at := segment.text.find(c) if c else 1 << 60) >= 0)
        return replace(previous, label="Yes", quote=found[1], raw_start=segment.raw_start + found[0], method="synthetic rule") if found[1] else replace(previous, method="synthetic rule")


def objection(decision: Decision, segment: Segment, previous: Decision) -> str | None:
    """Why a decision does not hold: an unknown label, Yes without a quote, a quote that is not where it is said to be."""
    if decision.label not in LABELS:
        return f"label {decision.label!r} is none of {LABELS}"
    if decision.label == "Yes" and not decision.quote:
        return "Yes needs an exact quote"
    if decision.quote and (decision.quote, decision.raw_start) != (previous.quote, previous.raw_start):
        at = (decision.raw_start if decision.raw_start is not None else -1) - segment.raw_start
        if at < 0 or segment.text[at : at + len(decision.quote)] != decision.quote:
            return "the quote is not an exact part of this segment at its offset"
    return None


def step(annotator: Annotator, segment: Segment, previous: Decision) -> Decision:
    """The decision after one more segment. A decision that does not hold is asked for once more with the objection; then the one before stays and the segment counts as failed."""
    made = annotator.decide(segment, previous, None)
    wrong = objection(made, segment, previous)
    if wrong:
        made = annotator.decide(segment, previous, wrong)
        if objection(made, segment, previous):
            return replace(previous, reviewed=previous.reviewed + 1, failed=previous.failed + 1)
    return replace(made, reviewed=previous.reviewed + 1, failed=previous.failed)


SCHEMA = "case_id string, label string, quote string, raw_start long, reviewed long, failed long, method string"
_KINDS = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def case_segments(texts: DataFrame, case: str, text: str, size: int) -> DataFrame:
    """case_id, place, raw_start, text: overlapping segments of each case's text; an empty text is one empty segment."""
    s = texts.select(F.col(case).cast("string").alias("case_id"), F.posexplode(segments(F.col(text), size)).alias("place", "s"))
    return s.select("case_id", F.col("place").cast("long").alias("place"), F.col("s.raw_start").cast("long").alias("raw_start"), "s.text")


def review(segs: DataFrame, annotator: Annotator) -> DataFrame:
    """The last decision of each case (SCHEMA), folded over its segments in order of place. segs: as in case_segments; (case_id, place) is unique. Rows without case_id take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, now = None, Decision()
        for b in batches:
            done = []
            for s in (Segment(*r.values()) for r in b.to_pylist()):
                if s.case_id != case:
                    if case is not None:
                        done.append((case, *asdict(now).values()))
                    case, now = s.case_id, Decision()
                now = step(annotator, s, now)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), _KINDS, strict=True)], names=SCHEMA_NAMES)
        if case is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((case, *asdict(now).values()), _KINDS, strict=True)], names=SCHEMA_NAMES)

    rows = segs.where("case_id IS NOT NULL").select("case_id", "place", "raw_start", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("case_id").sortWithinPartitions("case_id", "place").mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def review_stream(segs: DataFrame, annotator: Annotator) -> DataFrame:
    """The same over a stream: after each batch the new decision of every case that had segments in it. A case's segments arrive in batches in order of place; the state of a case is one decision."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Decision(*(None if pd.isna(v) else v for v in state.get)) if state.exists else Decision()
        rows = pd.concat(list(parts)).sort_values("place")  # of one case in one batch
        for r in rows.itertuples():
            now = step(annotator, Segment(key[0], r.place, r.raw_start, r.text or ""), now)
        state.update(tuple(asdict(now).values()))
        yield pd.DataFrame([(key[0], *asdict(now).values())], columns=SCHEMA_NAMES)

    held = SCHEMA.split(", ", 1)[1]
    return segs.where("case_id IS NOT NULL").groupBy("case_id").applyInPandasWithState(run, SCHEMA, held, "update", "NoTimeout")
