"""Approximate nearest neighbours by learned partitions.

Fit, on at most sample_rows vectors chosen by a hash: the exact neighbour graph of the sample, a balanced
partitioning of that graph (median splits, then capacity-bound moves that cut fewer edges), and a
small network that predicts a vector's partition, trained on where its neighbours lie. The number of partitions
follows the table (one for rows_per_part rows, at most max_parts, and sample_rows / 32), the number of
partitions probed is the least that finds `recall` of the sample's own neighbours.

Search: every row goes to its most probable partition, every query to its most probable ones, and the
exact Euclidean distance, in double precision on the original vectors, ranks what is met. A query that has
met fewer than k other rows goes on to its next partitions, twice as many each time, until it has k or all are read. A partition
(of rows or of queries) over `block` rows is split by a hash of vec_id and each pair of blocks is a
group of its own, so no partition, however large, meets in one task; the best of the blocks are then merged.

Of equal vectors only the k + 1 smallest vec_ids can be among anyone's k nearest, so only those are members, and
equal queries are searched once: a vector that a third of all rows hold is as cheap as any other.

A table whose partitions would hold more than rows_per_part rows is partitioned again: each partition gets a graph,
a partitioning and a router of its own, fitted on at most sample_rows of its rows, and rows and queries are routed
on within it. So the rows that a query meets do not grow with the table.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another dimension than the smallest valid vec_id's. Rows without vec_id take no part; of several rows
with one vec_id the smallest vector counts. Ties go to the smaller vec_id; fewer than k candidates give
fewer rows; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm._common import discard, materialize, table


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest rows of each row, itself excluded."""
    sq = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        d = sq[i : i + 512, None] - 2 * x[i : i + 512] @ x.T + sq
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        out[i : i + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Partition of the graph's nodes into parts of nearly equal size that cuts few edges."""
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:  # split the largest by its widest direction at the median
        groups.sort(key=len)
        g = groups.pop()
        c = x[g] - x[g].mean(0)
        v = np.linalg.eigh(c.T @ c)[1][:, -1]
        o = g[np.argsort(c @ v, kind="stable")]
        groups += [o[: len(o) // 2], o[len(o) // 2 :]]
    for i, g in enumerate(groups):
        part[g] = i
    most = int(np.ceil(slack * len(x) / parts))
    n = len(x)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate((src, dst)), np.concatenate((dst, src))
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        to = votes.argmax(1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < most:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """A network of one hidden layer from vectors to partition probabilities."""

    def __init__(self, dim: int, parts: int, hidden: int = 96, seed: int = 11):
        r = np.random.default_rng(seed)
        self.center, self.scale = np.zeros(dim), 1.0
        self.w = [r.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), r.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.center) / self.scale) @ self.w[0] + self.w[1], 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 4e-3) -> Router:
        self.center, self.scale = x.mean(0), float(x.std()) or 1.0
        r = np.random.default_rng(5)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for e in range(epochs):
            step = rate * (1 - e / epochs)
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                z = (x[at] - self.center) / self.scale
                h = np.maximum(z @ self.w[0] + self.w[1], 0)
                s = h @ self.w[2] + self.w[3]
                p = np.exp(s - s.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - target[at]) / len(at)
                dh = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((z.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def fit(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router | None, int]:
    """The router and the number of partitions to probe."""
    if parts < 2:
        return None, 1
    graph = knn_graph(x, min(k, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / (graph.shape[1] + 1))
    target[np.arange(len(x)), part] += 1 / (graph.shape[1] + 1)
    router = Router(x.shape[1], parts).fit(x, target)
    order = np.argsort(-router.scores(x), 1, kind="stable")
    home = order[:, 0]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    depth = place[np.arange(len(x))[:, None], home[graph]]  # probes needed to meet each neighbour
    return router, int(np.quantile(depth, recall, method="higher")) + 1


def _valid(rows: DataFrame) -> DataFrame:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _routed(router: Router | None, x: np.ndarray, first: int, last: int) -> np.ndarray:
    """The partitions of rank first .. last - 1 of each row, most probable first."""
    if router is None:
        return np.zeros((len(x), 1 if first == 0 else 0), np.int64)
    return np.argsort(-router.scores(x), 1, kind="stable")[:, first:last]


def _route(model, first: int, last: int):
    def run(batches):
        router = model.value
        for b in batches:
            if not b.num_rows:
                continue
            order = _routed(router, _matrix(b.column(1)), first, last)
            at = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(order.ravel().astype(np.int32)), pa.array(np.zeros(order.size, np.int32))], names=["vec_id", "v", "part", "sub"])

    return run


def _fit_group(k: int, rows_per_part: int, max_parts: int, recall: float):
    def run(key, t):
        x = _matrix(t["v"])
        parts = max(1, min(t["total"][0].as_py() // rows_per_part, max_parts, len(x) // 32))
        router, probes = fit(x, parts, k, recall)
        return pa.table([t["part"][:1], pa.array([pickle.dumps(router)], pa.binary()), pa.array([probes], pa.int32())], names=["part", "model", "probes"])

    return run


def _route_group(one: bool):
    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        rows = rows.select(["vec_id", "v", "part", "sub"])
        if not rows.num_rows or not models.num_rows:
            return rows
        order = _routed(pickle.loads(models["model"][0].as_py()), _matrix(rows["v"]), 0, 1 if one else models["probes"][0].as_py())
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), order.shape[1])))
        return rows.set_column(3, "sub", pa.array(order.ravel().astype(np.int32)))

    return run


def _rerank(k: int):
    """The k nearest rows of each query of a group. A matrix product leaves out what is farther for certain, exact distances rank the rest."""
    names = ["query_id", "vec_id", "score"]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if rows.num_rows and queries.num_rows:
            x, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
            qs, qids = _matrix(queries["v"]), queries["vec_id"].to_numpy()
            sq = (x * x).sum(1)
            for i in range(0, len(qs), 64):
                q = qs[i : i + 64]
                qq = (q * q).sum(1)[:, None]
                rough = sq + qq - 2 * q @ x.T
                slack = 1e-12 * (x.shape[1] + 8) * (sq.max() + qq)
                most = (np.partition(rough, k - 1, 1)[:, k - 1 : k] if len(x) > k else rough.max(1, keepdims=True)) + 2 * slack
                for j, near in enumerate(rough <= most) if np.isfinite(rough).all() else enumerate(np.ones(rough.shape, bool)):
                    near = np.flatnonzero(near)
                    d = np.sqrt(((x[near] - q[j]) ** 2).sum(1))
                    best = np.lexsort((ids[near], d))[:k]
                    out_q.append(np.full(len(best), qids[i + j]))
                    out_v.append(ids[near[best]])
                    out_s.append(d[best])
        if not out_q:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        return pa.table([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=names)

    return run


KEY = ["part", "sub"]


def _blocks(df: DataFrame, block: int, name: str) -> DataFrame:
    """part, sub and the number of blocks of each partition."""
    return df.groupBy(*KEY).agg(F.ceil(F.count("*") / block).cast("int").alias(name))


def _met(members: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: of each pair of a block of rows and a block of queries of a partition the k nearest."""
    counts = F.broadcast(_blocks(members, block, "nm").join(_blocks(queries, block, "nq"), KEY))  # a row a partition
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = members.join(counts, KEY).withColumn("mb", own("nm")).withColumn("qb", each("nq")).drop("nm", "nq")
    right = queries.join(counts, KEY).withColumn("qb", own("nq")).withColumn("mb", each("nm")).drop("nm", "nq")
    key = [*KEY, "mb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(rows: DataFrame, every: int = 100, k: int = 10, sample_rows: int = 8192, rows_per_part: int = 800, max_parts: int = 256, recall: float = 0.985, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = rows.sparkSession
    valid = materialize(_valid(rows), "vectors")
    one = valid.orderBy("vec_id").select(F.size("v").alias("d")).limit(1).collect()
    same = valid.where(F.size("v") == (one[0]["d"] if one else 0))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = materialize(same.withColumn("at", rank).where(F.col("at") <= k + 1).drop("at"), "held")
    asked = same.where(F.col("vec_id") % every == 0)
    groups = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"), "asked")
    n = held.count()
    sample = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    parts = max(1, min(n // rows_per_part, max_parts, sample.num_rows // 32))
    router, probes = fit(_matrix(sample["v"]), parts, k, recall) if sample.num_rows else (None, 1)
    model = spark.sparkContext.broadcast(router)
    routed = "vec_id long, v array<double>, part int, sub int"
    members = materialize(held.mapInArrow(_route(model, 0, 1), routed), "members")
    to = lambda q, first, last: q.mapInArrow(_route(model, first, last), routed)
    queries = to(groups, 0, probes)
    whole = members
    if n > 2 * parts * rows_per_part:
        place = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"))
        sizes = F.broadcast(members.groupBy("part").agg(F.count("*").alias("total")))  # max_parts rows
        samples = members.withColumn("at", F.row_number().over(place)).where(F.col("at") <= sample_rows).select("part", "v").join(sizes, "part")
        models = materialize(samples.groupBy("part").applyInArrow(_fit_group(k, rows_per_part, max_parts, recall), "part int, model binary, probes int"), "models")

        def on(t: DataFrame, one: bool) -> DataFrame:
            blocks = t.groupBy("part").agg(F.ceil(F.count("*") / (8 * block)).cast("int").alias("n"))
            left = t.join(F.broadcast(blocks), "part").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")).drop("n")
            right = models.join(F.broadcast(blocks), "part").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
            return left.groupBy("part", "b").cogroup(right.groupBy("part", "b")).applyInArrow(_route_group(one), routed)

        members = materialize(on(members, True), "members")
        queries = on(queries, False)
    queries = materialize(queries, "queries")
    found = materialize(_best(_met(members, queries, k + 1, block), k + 1).drop("rank"), "found")
    wanted, first = min(k + 1, n), probes
    while first < parts or (first == probes and members is not whole):  # some query may have met too few rows
        counts = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted)
        short = materialize(groups.join(counts.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
        if short.isEmpty():
            break
        last = min(parts, 2 * first)
        begin = 0 if members is not whole and first == probes else first  # of partitions of partitions none is known to be read whole
        more = materialize(to(short, begin, last), "queries")
        found = materialize(_best(_met(whole, more, k + 1, block).unionByName(found).distinct(), k + 1).drop("rank"), "found")
        if last == parts:
            break
        first = last
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 at most
    of = lists.join(groups, lists["query_id"] == groups["vec_id"]).select("v", "near")
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.withColumnRenamed("vec_id", "query_id").join(of, "v").select("query_id", F.posexplode(near).alias("at", "x"))
    out = materialize(out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"), "neighbours")
    discard(valid, held, groups, whole, members, queries, found)
    return out


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
