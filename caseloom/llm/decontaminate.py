"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact check.

An item of n shingles (five words each) is compared with the windows of n shingles of every text:

1. Windows are fingerprinted (64-bit SimHash, a shingle's weight is its multiplicity). A window that
   can reach the similarity holds at least ceil(2t / (1 + t) * n) shingles of one item; windows below
   that bound score under t for certain and are passed over unhashed.
2. Fingerprints of the items of that size are found by 8 blocks of 8 bits: within Hamming radius r
   some block differs by at most r // 8 bits, so the buckets of all block values within that distance miss
   no item within the radius.
3. Candidates are verified by the exact weighted Jaccard similarity of the shingle multisets.

Fingerprints of multisets with similarity 0.8 differ in 10 bits on average (standard deviation 3); the
default radius of 24 stands over 4 deviations away.

The benchmark is read in blocks of at most block_bytes of text; each block is one index, about ten times as large,
broadcast for one pass over the texts and freed when that is written, so a benchmark of any size works with bounded
memory. A benchmark of one block takes no written table.

Words are runs of ASCII letters and digits and non-ASCII characters, with A-Z and the Latin-1 capitals
lower-cased, so case and punctuation do not hide a leak. An item (or text) of fewer than five words is
one shingle, its whole sequence: such an item is found only where it is a whole text. A text shorter than an
item is one window.

Edge cases: null and empty texts and items match nothing; a null doc_id or item_id is kept; repeated
rows match alike; of equally similar windows the first is reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm._common import discard, materialize, small_batches, table
from caseloom.llm.textkernel import ALNUM, Words, shingles, words

K = 5
_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def simhash(h: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes; repeated ones weigh as often as they occur, ties give 0."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h)).tobytes(), "big")


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted values, multiplicities): sum of minima over sum of maxima."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    low = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def _bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


class Buckets:
    """The fingerprints of the items of one size, bucketed by the value of each of their 8 blocks of 8 bits."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        blocks = prints[:, None].view(np.uint8)
        self.order = [np.argsort(blocks[:, b], kind="stable").astype(np.int32) for b in range(8)]
        self.bound = [np.searchsorted(blocks[o, b], np.arange(257)) for b, o in enumerate(self.order)]

    def within(self, fingerprint: int, radius: int) -> list[tuple[int, int]]:
        """(item, distance) of all items within the radius: the buckets near each block, then exact distances."""
        f = np.uint64(fingerprint)
        met = np.zeros(len(self.items), bool)
        for b, u in enumerate(np.array([f]).view(np.uint8).tolist()):
            near = np.flatnonzero(_POP8[np.arange(256) ^ u] <= radius // 8)
            first, n = self.bound[b][near], self.bound[b][near + 1] - self.bound[b][near]
            met[self.order[b][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        at = np.flatnonzero(met)
        d = np.bitwise_count(self.prints[at] ^ f)
        return [(int(self.items[i]), int(x)) for i, x in zip(at, d, strict=True) if x <= radius]


class Index:
    """Items of one block: shingle -> items, and the Hamming buckets of each item size."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float, radius: int):
        self.t, self.radius, self.ids, self.bags, self.size = similarity, radius, [], [], []
        prints = []
        for item_id, text in items:
            for w in words(pa.array([text], pa.string()), ALNUM, fold=True):
                h, _, _ = shingles(w, K)
                if len(h):
                    self.ids.append(item_id)
                    self.bags.append(_bag(h))
                    self.size.append(len(h))
                    prints.append(simhash(h))
        self.print = np.array(prints, np.uint64)
        flat = np.concatenate([u for u, _ in self.bags]) if prints else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(prints)), [len(u) for u, _ in self.bags])
        order = np.argsort(flat, kind="stable")
        self.keys, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.first, self.count = owner[order], first, count
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        sizes = np.array(self.size, np.int64)
        self.buckets = {int(n): Buckets(at := np.flatnonzero(sizes == n), self.print[at]) for n in np.unique(sizes)}

    def within(self, n: int, fingerprint: int) -> list[tuple[int, int]]:
        """(item, distance) of all items of n shingles within the radius."""
        return self.buckets[n].within(fingerprint, self.radius) if n in self.buckets else []

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that items hold, with those items."""
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[key] == h[at]
        at, key = at[ok], key[ok]
        n = self.count[key]
        pos = np.repeat(at, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pos, self.owner[np.repeat(self.first[key], n) + step]

    def leaks(self, w: Words) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, distance, first word, last word) of each leak in a slice."""
        h, doc, first_word = shingles(w, K)
        pos, item = self.hits(h)
        if not len(pos):
            return
        bound = np.searchsorted(doc, np.arange(w.n + 1))
        order = np.lexsort((pos, item, doc[pos]))
        pos, item = pos[order], item[order]
        cut = np.flatnonzero(np.diff(doc[pos] * len(self.ids) + item)) + 1
        windows: dict[tuple[int, int], set[int]] = {}
        for p in np.split(np.arange(len(pos)), cut):
            d, i = int(doc[pos[p[0]]]), int(item[p[0]])
            lo, hi, n = int(bound[d]), int(bound[d + 1]), self.size[i]
            m = min(n, hi - lo)
            need = int(np.ceil(self.t / (1 + self.t) * (n + m) - 1e-9))
            if len(p) < need:
                continue
            x = pos[p]
            begin, last = x[: len(x) - need + 1], x[need - 1 :]
            for a, b in zip(begin.tolist(), last.tolist(), strict=True):
                if b - a < m:
                    windows.setdefault((d, n), set()).update(range(max(lo, b - m + 1), min(a, hi - m) + 1))
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for (d, n), starts in sorted(windows.items()):
            m = min(n, int(bound[d + 1] - bound[d]))
            for q in sorted(starts):
                seq = h[q : q + m]
                bag = None
                for i, dist in self.within(n, simhash(seq)):
                    bag = bag or _bag(seq)
                    s = bag_similarity(bag, self.bags[i])
                    if s >= self.t - 1e-12 and s > best.get((d, i), (0.0,))[0]:
                        last = int(first_word[q + m - 1])
                        end = last
                        while end + 1 < len(w.doc) and w.doc[end + 1] == d and end - last < K - 1:
                            end += 1
                        best[d, i] = (s, dist, int(first_word[q]), end)
        for (d, i), (s, dist, a, b) in best.items():
            yield d, i, s, dist, a, b


def _blocks(benchmark: DataFrame, similarity: float, radius: int, block_bytes: int) -> Iterator[tuple]:
    """(broadcast index, whether it is the only one), one at a time; the caller destroys it."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in part.toArrow().to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows, similarity, radius)), n == 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 24, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per (row of docs, item) at or over the similarity: doc_id, item_id, similarity, hamming,
    start_char, end_char (span of the best window in the text, code points, end exclusive)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for index, only in _blocks(benchmark, similarity, radius, block_bytes):

        def run(batches, index=index):
            ix = index.value
            for batch in batches:
                ids = batch.column(0)
                cols: list[list] = [[] for _ in range(6)]
                for w in words(batch.column(1), ALNUM, fold=True):
                    for d, i, s, dist, a, b in ix.leaks(w):
                        lo = int(w.offs[d])
                        a, b = int(w.start[a]), int(w.end[b])
                        before = len(w.data[lo:a].tobytes().decode())
                        for c, v in zip(cols, (ids[w.first + d].as_py(), ix.ids[i], s, dist, before, before + len(w.data[a:b].tobytes().decode())), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "hamming", "start_char", "end_char"])

        part = src.mapInArrow(run, "doc_id long, item_id long, similarity double, hamming int, start_char int, end_char int")
        if not only:
            part = materialize(part, "leaks")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 24, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs in whose text no item leaks, all columns kept; no shuffle."""
    small_batches(docs.sparkSession)
    at, schema, last = docs.columns.index("text"), docs.schema, None
    for index, only in _blocks(benchmark, similarity, radius, block_bytes):

        def run(batches, index=index):
            ix = index.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for w in words(batch.column(at), ALNUM, fold=True):
                    for leak in ix.leaks(w):
                        keep[w.first + leak[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
        if not only:
            docs = materialize(docs, "clean")
            index.destroy()
            discard(last)
            last = docs
    return docs


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
