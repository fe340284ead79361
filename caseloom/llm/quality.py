"""Quality classifier by compression: zstandard dictionaries trained on good and on bad texts.

A whole text is compressed in blocks of BLOCK bytes with each dictionary. Its score is a logistic
function of the normalised difference of the two compressed sizes, (bad - good) / (bad + good), and
of the log of compressed bytes per byte, which tells repetition that either dictionary shortens alike.
The logistic function is fitted on labelled texts that are not in the dictionaries, with weights that
restore the share of good labels.

At most per_class labelled texts of a class are used (default 2000; max_bytes each), chosen by a hash.

Edge cases: null and empty texts are scored as a text of size 0; without labels of both classes every
score is 0.5; repeated rows get equal scores; a null doc_id is not held out; the columns doc_id, held_out, score and predicted are
the result, other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm._common import small_batches, table
from caseloom.llm.labels import fold_of, labelled_sample

BLOCK, DICT_BYTES, DICT_SHARE = 512, 112 << 10, 0.35


def _dictionary(texts: list[str]) -> bytes:
    parts = [b[i : i + BLOCK] for b in (t.encode() for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the texts themselves serve
        return b"".join(parts)[:DICT_BYTES]


def _compressor(d: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)


class Model:
    """Two dictionaries and the logistic function; compressors are made where it is used."""

    def __init__(self, good: bytes, bad: bytes):
        self.dicts, self.center, self.scale, self.coef = (good, bad), np.zeros(2), np.ones(2), np.zeros(3)

    def features(self, texts: list[str | None]) -> np.ndarray:
        good, bad = map(_compressor, self.dicts)
        out = np.empty((len(texts), 2))
        for r, t in enumerate(texts):
            b = (t or "").encode()
            g = x = 0
            for i in range(0, max(1, len(b)), BLOCK):
                part = b[i : i + BLOCK]
                g += len(good.compress(part))
                x += len(bad.compress(part))
            out[r] = (x - g) / (x + g), math.log(((x + g) / 2 + 8) / (len(b) + 16))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        f = np.c_[(self.features(texts) - self.center) / self.scale, np.ones(len(texts))]
        return 1 / (1 + np.exp(-np.clip(f @ self.coef, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last column of x is the constant."""
    c = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (w * (p - y)) + ridge * c)
        c = c - step
        if np.abs(step).max() < 1e-9:
            break
    return c


def train(sample: list[tuple[str, int]], share: float) -> Model | None:
    by = [[t for t, y in sample if y == k] for k in (0, 1)]
    if not all(by):
        return None
    head = [max(1, int(len(t) * DICT_SHARE)) for t in by]
    model = Model(_dictionary(by[1][: head[1]]), _dictionary(by[0][: head[0]]))
    rest = [t[h:] or t for t, h in zip(by, head, strict=True)]
    f = model.features(rest[0] + rest[1])
    y = np.repeat([0.0, 1.0], [len(r) for r in rest])
    model.center, model.scale = f.mean(0), f.std(0) + 1e-9
    w = np.where(y == 1, share / len(rest[1]), (1 - share) / len(rest[0]))
    model.coef = fit_logistic(np.c_[(f - model.center) / model.scale, np.ones(len(f))], y, w)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, per_class: int = 2000, max_bytes: int = 32 << 10) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", folds) == held_out).alias("held_out"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "quality", folds, held_out, per_class, max_bytes)))

    def run(batches):
        m = model.value
        for batch in batches:
            s = m.score(batch.column(2).to_pylist()) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, per_class: int = 2000, max_bytes: int = 32 << 10) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns kept; no shuffle."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "quality", folds, held_out, per_class, max_bytes)))
    at = docs.columns.index("text")

    def run(batches):
        m = model.value
        for batch in batches:
            s = m.score(batch.column(at).to_pylist()) if m else np.full(batch.num_rows, 0.5)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
