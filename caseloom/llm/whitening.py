"""Embedding whitening with an exact covariance by digit-slice products.

Each entry c becomes the integer x = floor(64 c) + 1000000. Over the fit list (each distinct x vector once: n vectors, sums S) the
centred integers y = n x - S give the covariance V = sum(y y') / n^3 without any rounding: y is split into signed limbs of
LIMB bits, a product of two limb matrices of at most BLOCK rows stays below 2^53 and so is exact in float64 BLAS, and the products of a
block are put together as Python integers by the weight of their limbs. Spark adds these up, row by row of the matrix, in two
levels. The largest axis is shared only once: V (dimension by dimension) goes to the driver, which rounds it once and takes its eigenvectors.

Components with an eigenvalue that rounding cannot tell from 0 (dimension * 2^-52 of the largest) have no whitened value and are left out.

Tables: one row for each distinct vector is written once (copies are combined before the shuffle, so a vector that a third of all
rows hold is one row); every pass after that reads it in batches. Nothing that grows with the number of vectors reaches the driver.

Edge cases: rows whose vector is null or holds a null or non-finite entry are dropped, and so are rows with another dimension than the smallest
vec_id's (rows without vec_id come last), empty vectors, and entries of a size at which 64 c is no long. Null vec_ids stay; repeated rows each get their values; ties do not
matter; one distinct vector, or an empty table, gives no rows: there is no component. deviation needs to fit a long, else the job fails and says so. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm._common import discard, materialize, table

LIMB, BLOCK = 20, 4096  # 2 * 20 bits a product, 12 bits of rows: 52 of the 53 bits that float64 holds
SCALE, SHIFT, COMPONENTS = 64, 1000000, 16
#: partial sums that one task adds up
FAN_IN = 64


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that remain."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    v = v.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0**56)))
    x = v.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    first = x.groupBy(F.size("x").alias("d")).agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("least")).orderBy("least", "d").first()
    return x.where(F.size("x") == (first["d"] if first else 0))


def _matrix(col: pa.Array, kind=np.int64) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S exactly: int64 where it fits, else Python integers."""
    fits = n * int(np.abs(x).max(initial=1)) < 2**62 and all(abs(int(v)) < 2**62 for v in s)
    return x * n - s.astype(np.int64) if fits else x.astype(object) * n - s


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Float matrices of signed limbs, lowest first: y is the sum of limbs[k] * 2^(LIMB k), and no limb is over 2^(LIMB - 1)."""
    out, half, base = [], 1 << (LIMB - 1), 1 << LIMB
    while True:
        low = (y + half) % base - half
        out.append(low.astype(np.float64))
        y = (y - low) // base
        if not np.any(y):
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y in Python integers, by products of limbs that are exact in float64."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), BLOCK):
        part = limbs(y[i : i + BLOCK])
        orders: list[np.ndarray] = [np.zeros(total.shape, np.int64) for _ in range(2 * len(part) - 1)]
        for j, a in enumerate(part):
            for k in range(j, len(part)):
                p = (a.T @ part[k]).astype(np.int64)
                orders[j + k] += p if j == k else p + p.T
        for w, p in enumerate(orders):
            total += p.astype(object) << (LIMB * w)
    return total


def _partial(n: int, s: list[str]):
    """A row for each row of the matrix: this partition's sums, as decimal text. Rows that wait for a block are bounded by a batch and a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.array([int(v) for v in s], object), None
        for b in batches:
            if b.num_rows:
                g = gram(_centred(_matrix(b.column(0)), n, sums))
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([[str(v) for v in row] for row in total], pa.list_(pa.string()))], names=["i", "sums"])

    return run


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum((np.array([int(v) for v in r.as_py()], object) for r in rows["sums"]), 0)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], names=["i", "sums"])


def exact_scatter(fit: DataFrame, n: int, s: list[int]) -> list[list[int]]:
    """sum((n x - S)(n x - S)') over the fit list, as Python integers."""
    parts = fit.select("x").mapInArrow(_partial(n, [str(v) for v in s]), "i int, sums array<string>")
    parts = materialize(parts.withColumn("at", F.floor(F.spark_partition_id() / FAN_IN)), "partial")
    some = parts.groupBy("i", "at").applyInArrow(_added, "i int, sums array<string>")
    rows = some.groupBy("i").applyInArrow(_added, "i int, sums array<string>").orderBy("i").collect()  # a row for each dimension
    discard(parts)
    return [[int(v) for v in r["sums"]] for r in rows]


def fit_whitening(fit: DataFrame) -> tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray] | None:
    """n, S, the projection (dimension by component: eigenvectors over the roots of their eigenvalues), the eigenvalues and their shares of the trace."""
    n = fit.count()
    if not n:
        return None
    exact = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    s = [int(r["s"]) for r in exact]
    scatter = exact_scatter(fit, n, s)
    cube = n**3
    v = np.array([[c / cube for c in row] for row in scatter])  # true division of integers: rounded once
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    held = int((e > max(e[0], 0) * len(e) * 2.0**-52).sum())
    kept = min(COMPONENTS, held)
    trace = sum(scatter[i][i] for i in range(len(s))) / cube
    return n, s, vectors[:, :kept] / np.sqrt(e[:kept]), e[:kept], e[:kept] / trace if trace else e[:kept]


def whitened(x: np.ndarray, n: int, s: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (_centred(x, n, s) / n).astype(np.float64) @ projection


def _moments(n: int, s: list[str], projection: np.ndarray):
    """count, sums and sums of products about the partition's mean, of the whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, k = np.array([int(v) for v in s], object), projection.shape[1]
        count, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = whitened(_matrix(b.column(0)), n, sums, projection)
                m = w.mean(0)
                d, c = m - mean, w - m
                about += c.T @ c + np.outer(d, d) * (count * len(w) / (count + len(w)))
                mean = mean + d * (len(w) / (count + len(w)))
                count += len(w)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([mean.tolist()]), pa.array([about.ravel().tolist()])], names=["count", "mean", "about"])

    return run


def _together(key: tuple, rows: pa.Table) -> pa.Table:
    count, mean, about = 0, 0.0, 0.0
    for c, m, a in zip(*(rows[x].to_pylist() for x in ("count", "mean", "about")), strict=True):
        m, a = np.array(m), np.array(a)
        d = m - mean
        about = about + a + np.outer(d, d).ravel() * (count * c / (count + c))
        mean = mean + d * (c / (count + c))
        count += c
    return pa.table([pa.array([count], pa.int64()), pa.array([np.asarray(mean).tolist()]), pa.array([np.asarray(about).tolist()])], names=["count", "mean", "about"])


def identity_error(fit: DataFrame, n: int, s: list[int], projection: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, from the whitened values themselves."""
    kind = "count long, mean array<double>, about array<double>"
    parts = fit.select("x").mapInArrow(_moments(n, [str(v) for v in s], projection), kind)
    parts = parts.withColumn("at", F.floor(F.spark_partition_id() / FAN_IN))
    some = parts.groupBy("at").applyInArrow(lambda k, t: _together(k, t), kind)
    total = some.groupBy(F.lit(0).alias("at")).applyInArrow(lambda k, t: _together(k, t), kind).first()  # a row for each FAN_IN partitions
    k = projection.shape[1]
    return float(np.abs(np.array(total["about"]).reshape(k, k) / total["count"] - np.eye(k)).max())


def _projected(n: int, s: list[str], projection: np.ndarray, explained: np.ndarray, error: float):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def deviation(y: np.ndarray) -> np.ndarray:
        fits = int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2**63
        return (y * y).sum(1) if fits else (y.astype(object) ** 2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, k = np.array([int(v) for v in s], object), projection.shape[1]
        for b in batches:
            if b.num_rows:
                y = _centred(_matrix(b.column(1)), n, sums)
                w = (y / n).astype(np.float64) @ projection
                rows = len(w)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), pa.array(deviation(y).tolist(), pa.int64()).take(each), pa.array(w.ravel()),
                     pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))], names=names,
                )

    return run


def whiten(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = quantised(rows)
    fit = materialize(kept.select("x").distinct(), "fit")
    got = fit_whitening(fit)
    if got is None or not got[2].shape[1]:
        return rows.sparkSession.createDataFrame([], out)
    n, s, projection, _, explained = got
    error = identity_error(fit, n, s, projection)
    discard(fit)
    return kept.mapInArrow(_projected(n, [str(v) for v in s], projection, explained, error), out)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
