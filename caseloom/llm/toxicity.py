"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text are the presence of its words, their stems (first STEM bytes), word pairs and
pairs one word apart, each kind hashed into 2**BITS buckets. Training keeps a learning rate of its own for each coordinate; L1 sets the
weights of all but the telling features to exactly zero, so the model is a short sorted list of
buckets and weights, which is what is broadcast.

At most per_class labelled texts of a class are used (default 3000; max_bytes each), chosen by a hash;
the constant is set afterwards so that the share of toxic labels is restored.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z and Latin-1 capitals lower-cased.

Edge cases: null and empty texts have no features and get the constant's score; without labels of both classes every score is 0
and nothing is toxic; repeated rows get equal scores; a null doc_id is held out, as its fold is 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm._common import small_batches, table
from caseloom.llm.labels import fold_of, labelled_sample
from caseloom.llm.quality import fit_logistic
from caseloom.llm.textkernel import ALNUM, Words, mix64, words

BITS = 20
STEM = 5  # bytes
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 12.0, 0.1, 8
MIN_TEXTS = 3  # features of fewer texts of the sample are not trained


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature occurrence of a slice."""
    docs, hs = [w.doc, w.doc], [mix64(w.hash ^ np.uint64(1)), mix64(w.stem ^ np.uint64(4))]
    for gap in (1, 2):
        same = np.flatnonzero(w.doc[:-gap] == w.doc[gap:])
        docs.append(w.doc[same])
        hs.append(mix64(w.hash[same] * np.uint64(0x9E3779B97F4A7C15) + w.hash[same + gap] + np.uint64(gap + 1)))
    return np.concatenate(docs), (np.concatenate(hs) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, slope: float, const: float):
        self.buckets, self.weights, self.slope, self.const = buckets, weights, slope, const
        self.held = np.zeros(1 << BITS, np.int32)  # bucket -> 1 + place in weights
        self.held[buckets] = np.arange(1, len(buckets) + 1)

    def __reduce__(self):
        return Model, (self.buckets, self.weights, self.slope, self.const)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.const, -40, 40)))

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for w in words(texts, ALNUM, fold=True, stem=STEM):
            doc, b = features(w)
            place = self.held[b]
            on = np.flatnonzero(place)
            if len(on):
                pair = np.unique(doc[on].astype(np.int64) << 32 | (place[on] - 1))
                out[w.first : w.first + w.n] += np.bincount(pair >> 32, self.weights[pair & 0xFFFFFFFF], w.n)
        return out


def train(sample: list[tuple[str, int]], share: float) -> Model | None:
    y = np.array([v for _, v in sample], float)
    if not len(y) or y.min() == y.max():
        return None
    rows: list[np.ndarray] = []
    texts = pa.array([t for t, _ in sample], pa.large_string())
    for w in words(texts, ALNUM, fold=True, stem=STEM):
        doc, b = features(w)
        pair = np.unique(doc.astype(np.int64) << 32 | b)
        rows += np.split(pair & 0xFFFFFFFF, np.searchsorted(pair >> 32, np.arange(1, w.n)))
    texts_of = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    rows = [r[texts_of[r] >= MIN_TEXTS] for r in rows]
    fit, cal = np.arange(len(y)) % 5 != 0, np.arange(len(y)) % 5 == 0
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in rng.permutation(np.flatnonzero(fit)):
            x = rows[r]
            zx, nx = z[x], n[x]
            wx = np.where(np.abs(zx) > L1, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2), 0.0)
            wb = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(wx.sum() + wb, -35, 35))) - y[r]
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - s * wx
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * wb
            nb += g * g
    weight = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    on = np.flatnonzero(weight)
    model = Model(on, weight[on], 1.0, 0.0)
    m = model.margins(texts)
    if y[cal].min() == y[cal].max():
        cal = fit
    m, yc = m[cal], y[cal]
    w = np.where(yc == 1, share / max(1, (yc == 1).sum()), (1 - share) / max(1, (yc == 0).sum()))
    slope, const = fit_logistic(np.c_[m, np.ones(len(m))], yc, w)
    return Model(on, weight[on], float(slope), float(const))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5, per_class: int = 3000, max_bytes: int = 32 << 10) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", folds) == held_out).alias("held_out"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "toxic", folds, held_out, per_class, max_bytes)))

    def run(batches):
        m = model.value
        for batch in batches:
            s = m.score(batch.column(2)) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
