"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are whitespace-separated words. The cells source x lang x topic get weights that start at their
tokens and are raked in turn to the target share of each source, language and topic until all shares
are met (targets of values without tokens are dropped and the rest rescaled; values that a list of
targets does not name, nulls among them, keep the share of tokens they have). A cell's documents are then
taken with probability p = min(1, c * weight / tokens), where c makes the expected tokens equal the
budget; cells that reach 1 keep all they have and the rest is spread over the others.

The draw is a hash of doc_id and seed, so a rerun or a lost executor gives the same sample, and a
document's fate depends on nothing but its cell's p and its id.

Only the cell table leaves the executors, and only when it has at most max_cells rows; a larger one is
raked by the same steps on tables in the shared folder.

Edge cases: a null source, lang or topic is the value ''; null and empty texts have no tokens and are
never taken; with an empty table nothing is; a null doc_id draws as -1; repeated rows are taken or left
together; all columns of docs pass through, and the added ones replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from caseloom.llm._common import materialize, small_batches, table, unused
from caseloom.llm.textkernel import words

DIMS = ("source", "lang", "topic")
#: raking ends after so many rounds, or when all shares are met so closely; the same for arrays and tables
ROUNDS, EPS = 200, 1e-10
#: the first rule whose marker a text holds names its topic
TOPICS = (
    ("legal", ("License", "Copyright", "licensed under", "All rights reserved")),
    ("contact", ("@", "+1-", "+1 (")),
    ("tabular", (" | ",)),
    ("numeric", ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9")),
)


def topic_of(text: str = "text") -> Column:
    """Rule-based topic by markers; 'prose' when none is there."""
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(F.col(text), F.lit(m))
        out = F.when(hit, name).otherwise(out)
    return out


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs with tokens: whitespace-separated words of text, null and empty texts 0."""
    small_batches(docs.sparkSession)
    docs = docs.drop("tokens")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for w in words(batch.column(at)):
                n[w.first : w.first + w.n] = np.bincount(w.doc, minlength=w.n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "tokens"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("tokens", LongType())]))


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to totals ** power."""
    s = {k: v**power for k, v in totals.items() if v > 0}
    return {k: v / sum(s.values()) for k, v in s.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, eps: float = EPS) -> np.ndarray:
    """Cell weights (sum 1) whose marginals meet the shares; codes give each cell's value in each dimension."""
    w = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    for _ in range(rounds):
        off = 0.0
        for code, share in zip(codes, shares, strict=True):
            got = np.bincount(code, w, len(share))
            off = max(off, float(np.abs(got - share).max(initial=0)))
            w = w * np.divide(share, got, out=np.zeros_like(share), where=got > 0)[code]
        if off < eps:
            break
    return w


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """p = min(1, c * weight / tokens) with sum(p * tokens) = min(budget, all tokens that have weight)."""
    rate = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    p, full = np.zeros(len(rate)), np.zeros(len(rate), bool)
    while True:
        rest = weight[~full].sum()
        left = max(0.0, budget - tokens[full].sum())
        p = np.where(full, 1.0, rate * (left / rest if rest else 0))
        over = (p >= 1) & ~full & (rate > 0)
        if not over.any():
            return p
        full |= over


def _shares(totals: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """A target is the share of each value, or a power that tempers the totals. Values that a target does not
    list keep their share of the tokens, and the listed ones divide the rest."""
    if not isinstance(target, dict):
        return tempered(totals, target)
    have = {k: v for k, v in totals.items() if v > 0}
    listed = sum(target.get(k, 0.0) for k in have)
    other = sum(v for k, v in have.items() if k not in target)
    whole = sum(have.values()) if listed else other
    return {k: (target[k] / listed * (whole - other) / whole if listed else 0.0) if k in target else v / whole for k, v in have.items()}


def _probabilities(cells: DataFrame, targets: dict, fraction: float, max_cells: int) -> DataFrame:
    if cells.limit(max_cells + 1).count() <= max_cells:
        got = cells.toArrow().to_pandas().sort_values(list(DIMS)).reset_index(drop=True)
        tokens = got["tokens"].to_numpy(float)
        codes, shares = [], []
        for d in DIMS:
            code, values = got[d].factorize()
            share = _shares(dict(zip(values, np.bincount(code, tokens, len(values)), strict=True)), targets[d])
            codes.append(code)
            shares.append(np.array([share.get(v, 0.0) for v in values]))
        w = rake(tokens, codes, shares) if len(got) else tokens
        got["weight"], got["p"] = w, calibrate(tokens, w, fraction * tokens.sum())
        return cells.sparkSession.createDataFrame(
            [(*map(str, r[:3]), *map(float, r[3:])) for r in got[[*DIMS, "weight", "p"]].itertuples(index=False)], "source string, lang string, topic string, weight double, p double"
        )
    return _rake_tables(cells, targets, fraction)


def _rake_tables(cells: DataFrame, targets: dict, fraction: float, rounds: int = ROUNDS, eps: float = EPS) -> DataFrame:
    """The same raking on tables, for more cells than the driver should hold."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    w = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0))
    for _ in range(rounds):
        off = 0.0
        for d in DIMS:
            sums = w.groupBy(d).agg(F.sum("weight").alias("got"), F.sum("tokens").alias("n"))
            if isinstance(targets[d], dict):
                listed = F.element_at(F.create_map(*[F.lit(x) for k, v in targets[d].items() for x in (k, float(v))]), F.col(d)) if targets[d] else F.lit(None).cast("double")
            else:
                listed = F.pow("n", F.lit(float(targets[d])))
            sums = materialize(sums.withColumn("want", F.when(F.col("n") > 0, listed).otherwise(0.0)), "marginal")
            t = sums.agg(F.sum("want").alias("listed"), F.sum(F.when(F.col("want").isNull(), F.col("n"))).alias("other")).first()
            if t["other"]:  # as in _shares
                whole = total if t["listed"] else float(t["other"])
                scale = (whole - t["other"]) / t["listed"] if t["listed"] else 0.0
                sums = sums.withColumn("want", F.coalesce(F.col("want") * F.lit(scale), F.col("n").cast("double")))
            else:
                whole = float(t["listed"] or 1.0)
            off = max(off, sums.agg(F.max(F.abs(F.expr(f"got - want / {whole!r}D")))).first()[0] or 0.0)
            w = materialize(w.join(sums, d).withColumn("weight", F.expr(f"CASE WHEN got > 0 THEN weight * want / {whole!r}D / got ELSE 0 END")).select(*DIMS, "tokens", "weight"), "raked")
        if off < eps:
            break
    rate, budget, full = "CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END", fraction * total, 0.0
    while True:  # the cells that are kept whole are those of the highest rates: full is the least such rate
        kept = F.expr(f"({rate}) >= {full!r}D") if full else F.lit(False)
        s = w.agg(F.sum(F.when(kept, F.col("tokens"))).alias("t"), F.sum(F.when(~kept, F.col("weight"))).alias("r")).first()
        c = max(0.0, budget - (s["t"] or 0)) / s["r"] if s["r"] else 0.0
        over = w.where(~kept).where(F.expr(f"({rate}) * {c!r}D >= 1")).agg(F.min(F.expr(rate))).first()[0]
        if not over:
            return w.withColumn("p", F.when(kept, 1.0).otherwise(F.expr(f"({rate}) * {c!r}D"))).select(*DIMS, "weight", "p")
        full = float(over)


def draw(id_col: str, seed: int) -> Column:
    """Uniform in [0, 1) from the id: 48 bits of a SHA-256."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-1")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, targets: dict, fraction: float = 0.5, seed: int = 17, max_cells: int = 100_000, topic: Column | None = None) -> DataFrame:
    """The sampled rows of docs with topic, tokens, mix_weight (raked share of the cell) and mix_p added."""
    topic = topic_of() if topic is None else topic
    rows = with_tokens(docs.withColumn("topic", topic))
    key = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMS}
    cells = materialize(rows.groupBy(*[c.alias(d) for d, c in key.items()]).agg(F.sum("tokens").alias("tokens")), "cells")
    p = _probabilities(cells, targets, fraction, max_cells)
    *cell, u = unused(rows, *[f"_cell_{d}" for d in DIMS], "_u")
    p = p.select(*[F.col(d).alias(c) for d, c in zip(DIMS, cell, strict=True)], F.col("weight").alias("mix_weight"), F.col("p").alias("mix_p"))
    on = F.lit(True)
    for name, c in zip(cell, key.values(), strict=True):
        on = on & (c == F.col(name))
    kept = rows.drop("mix_weight", "mix_p").withColumn(u, draw("doc_id", seed)).join(p, on)
    return kept.where((F.col("tokens") > 0) & (F.col(u) < F.col("mix_p"))).drop(u, *cell)


#: what the registered query mixes to: tempered sources and topics, fixed languages
TARGETS = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.7}


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), TARGETS).select("doc_id", "source", "lang", "topic", "tokens", "mix_weight", "mix_p")
