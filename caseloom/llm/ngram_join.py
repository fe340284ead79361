"""N-gram Jaccard join: a size-aware heavy-light set similarity join over word shingles.

A text's set is its distinct k-word shingles (fewer words: the whole sequence is one; none: empty).
Two texts link when |A & B| / |A | B| >= num / den. All texts of one set are one node.

* Light sets (size <= boundary) enumerate fixed-size subsets: for sizes m <= n a link needs an overlap
  of c(n, m), so both sides list their c-subsets under a key of (n, m) and linked pairs share one.
* Heavy sets scan inverted lists. Under one global order, rare shingles first, two linked sets share a
  shingle within their first n - minimal overlap + 1; only those are listed.
* The boundary comes from a cost model over the exact size histogram.

Lists are never expanded into all pairs. A list's head is the member with the fewest rarer shingles
before the list's own, so of a family of near copies the one with the fewest edits of its own, to which most
others link. First each node is compared with one head, the one it meets in most lists (a star). Exact
intersections make links, links make components. A list whose members are then all in one component holds
nothing more to find. In the others, nodes outside the list's largest component are compared with one head
of that again, ROUNDS times in all, and what is still apart then, members outside the largest component, with
members of other components, once for each pair (at the first shingle they share), unless their sizes, the
place of that shingle or parity bits of the two sets (1024, and for large sets two for each shingle) already show too many differences. Every pair that
could still join two components is verified, so components are exact whatever the size of a group.

Shingles are 64-bit hashes (see textkernel); the order's frequencies come from a sketch of fixed size
over all texts, which affects cost, never results.

Edge cases: null and empty texts have no shingles, link with nothing and are their own component; a
null doc_id stays null; repeated rows are equal sets, hence linked; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm._common import discard, materialize, small_batches, unused
from caseloom.llm.textkernel import mix64, shingles, signed, words
from caseloom.operators.graph import components

SKETCH_BITS = 24  # shingle frequencies: 2**24 counters, whatever the corpus; one byte each where they are used
PIECE_BITS = 12  # the sketch is summed in pieces of 2**12 counters
FILTER_BITS = 22  # membership bitmap in front of exact semi-joins: 512 KiB
PARITY = tuple(f"p{i}" for i in range(16))  # 1024 parity bits of a set
WIDE = 512  # larger sets also have a wide parity of about two bits for each shingle, a 32nd of their own size
ROUNDS = 2  # of stars
BACK = 8  # shared shingles of a pair are told from its first by so many listed before them; affects cost, never results
SEEN = 1 << 16  # nodes that a task remembers so as to list equal sets once
MAX_LIGHT = 24  # the largest boundary that the cost model may choose
LIST_COST = 4  # cost of one list entry against one enumerated subset: shuffled twice, then compared


def min_overlap(n: int, m: int, num: int, den: int) -> int:
    """The least overlap o of linked sets of sizes n and m: den * o >= num * (n + m - o)."""
    return -(-num * (n + m) // (den + num))


def prefix_len(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subset_plan(n: int, light: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(larger size, smaller size, subset size) for each way a light set of size n can link to one."""
    return [
        (max(n, m), min(n, m), min_overlap(n, m, num, den))
        for m in range(1, light + 1)
        if den * min(n, m) >= num * max(n, m)
    ]


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The boundary of least cost, given how many sets there are of each size."""

    def cost(x: int) -> int:
        low = -(-num * (x + 1) // den)
        light = sum(c * sum(comb(n, o) for _, _, o in subset_plan(n, x, num, den)) for n, c in sizes.items() if n <= x)
        heavy = sum(c * prefix_len(n, num, den) for n, c in sizes.items() if n >= low)
        return light + LIST_COST * heavy

    return min(range(MAX_LIGHT + 1), key=lambda x: (cost(x), x))


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per slice: index of its first text, each text's set as sorted distinct hashes, set sizes, nodes."""
    for w in words(col):
        h, doc, _ = shingles(w, k)
        bound = np.searchsorted(doc, np.arange(w.n + 1))
        for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            h[i:j].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, n = h[new], np.bincount(doc[new], minlength=w.n)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)))
        at = np.concatenate(([0], np.cumsum(n)))
        node = mix64((run[at[1:]] - run[at[:-1]]) ^ mix64(n.astype(np.uint64)))
        yield w.first, np.split(h, at[1:-1]), n, node.view(np.int64)


def _profile(k: int):
    """Sets of texts (piece null: doc_id, n, node) and, at the end of a task, its pieces of the sketch (piece, task, counts)."""
    names = ["doc_id", "n", "node", *PARITY, "wide", "piece", "task", "counts"]

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            for first, out, n, node in _sets(batch.column(1), k):
                at, c = np.unique(np.concatenate(out) & np.uint64((1 << SKETCH_BITS) - 1), return_counts=True)
                at = at.astype(np.int64)
                total[at] = np.minimum(total[at] + c, 65535)  # levels above that do not differ
                m = len(n)
                bit = np.concatenate(out) >> np.uint64(54)
                odd = np.zeros((len(PARITY), m), np.uint64)
                np.bitwise_xor.at(odd, ((bit >> np.uint64(6)).astype(np.int64), np.repeat(np.arange(m), n)), np.uint64(1) << (bit & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, m), pa.array(n.astype(np.int32)), pa.array(node), *map(signed, odd), pa.array([_wide(u) for u in out], pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names
                )
        pieces = total.reshape(-1, 1 << PIECE_BITS)
        on = np.flatnonzero(pieces.any(1))
        me = TaskContext.get().partitionId()
        for at in np.array_split(on, max(1, len(on) // 256)):
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * (1 + len(PARITY)), pa.nulls(m, pa.list_(pa.int64())), pa.array(at.astype(np.int32)), pa.array(np.full(m, me, np.int32)), pa.array([_pack(pieces[i]) for i in at], pa.binary())], names=names
            )

    return run


def _wide(u: np.ndarray) -> np.ndarray | None:
    """Parity of a large set in a power of two of words; half as many words are the XOR of the two halves."""
    if len(u) <= WIDE:
        return None
    words = 1 << (len(u) // 32).bit_length()
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((u >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (u & np.uint64(63)))
    return out.view(np.int64)


def _wide_bound(num: int, den: int) -> str:
    """As _difference_bound, for the wide parities of two large sets; true where one of them has none."""
    fold = lambda x: f"CASE WHEN size({x}) > least(size(a_wide), size(b_wide)) THEN zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (u, v) -> u ^ v) ELSE {x} END"
    d = f"aggregate(zip_with({fold('a_wide')}, {fold('b_wide')}, (u, v) -> bit_count(u ^ v)), 0, (s, c) -> s + c)"
    return f"coalesce({den + num} * cast({d} as long) <= {den - num} * cast(an + bn as long), true)"


def _pack(counts: np.ndarray) -> bytes:
    """Counters as two bytes each, saturated."""
    return zlib.compress(np.minimum(counts, 65535).astype(np.uint16).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint16).astype(np.uint32)


def _sum_pieces(t: pa.Table) -> pa.Table:
    total = np.zeros(1 << PIECE_BITS, np.uint32)
    for b in t["counts"].to_pylist():
        total += _unpack(b)
    return pa.table([t["piece"][:1], pa.array([_pack(total)], pa.binary())], names=["piece", "counts"])


def _sketch(pieces: DataFrame) -> np.ndarray:
    """Frequency levels, 2**SKETCH_BITS bytes. Pieces of 64 tasks are summed at a time, then their sums."""
    some = pieces.withColumn("lot", F.floor(F.col("task") / 64)).groupBy("piece", "lot").applyInArrow(_sum_pieces, "piece int, counts binary")
    level = np.zeros((1 << (SKETCH_BITS - PIECE_BITS), 1 << PIECE_BITS), np.uint8)
    for r in some.groupBy("piece").applyInArrow(_sum_pieces, "piece int, counts binary").toArrow().to_pylist():
        level[r["piece"]] = np.minimum(255, 15 * np.log2(1 + _unpack(r["counts"])))
    return level.ravel()


def _lists(k: int, num: int, den: int, light: int, levels):
    """List entries (token, node, n, pos): subset keys of light sets, prefixes of the others."""
    low = -(-num * (light + 1) // den)

    def run(batches):
        level, seen = levels.value, set()
        for _, out, n, node in (x for batch in batches for x in _sets(batch.column(0), k)):
            toks, nodes, ns, poss = [], [], [], []
            for u, size, me in zip(out, n.tolist(), node.tolist(), strict=True):
                if not size or me in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(me)
                if size <= light:
                    keys = np.array(_subset_keys(u, light, num, den), np.uint64)
                    toks.append(keys)
                    poss.append(np.full(len(keys), -1, np.int32))
                if size >= low:
                    key = (level[(u & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8))
                    head = u[np.argsort(key, kind="stable")[: prefix_len(size, num, den)]]
                    toks.append(head)
                    poss.append(np.arange(len(head), dtype=np.int32))
                m = sum(map(len, toks)) - sum(map(len, ns))
                nodes.append(np.full(m, me, np.int64))
                ns.append(np.full(m, size, np.int32))
            if toks:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(toks)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(poss))],
                    names=["token", "node", "n", "pos"],
                )

    return run


def _subset_keys(u: np.ndarray, light: int, num: int, den: int) -> list[int]:
    """A subset's key: the sum of its members' mixed hashes under the two sizes."""
    full = (1 << 64) - 1
    x = mix64(u).tolist()
    whole = sum(x)
    out = []
    for big, small, o in subset_plan(len(x), light, num, den):
        salt = (big * 0x9E3779B97F4A7C15 + small * 0xC2B2AE3D27D4EB4F) & full
        gone = combinations(x, len(x) - o)
        keys = np.array([(whole - sum(g)) & full for g in gone], np.uint64)
        out += mix64(keys ^ np.uint64(salt)).tolist()
    return out


def _wanted_sets(k: int, bitmap):
    """(node, hashes) of texts whose doc_id may be in the bitmap or is null; of a task's equal sets one."""

    def run(batches):
        bits, seen = bitmap.value, set()
        for batch in batches:
            ids = batch.column(0)
            at = _slot(ids.fill_null(0).to_numpy(zero_copy_only=False))
            ok = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            for _, out, n, node in _sets(batch.column(1).filter(pa.array(ok)), k):
                if len(seen) > SEEN:
                    seen.clear()
                pick = [i for i in np.flatnonzero(n) if not (int(node[i]) in seen or seen.add(int(node[i])))]
                if pick:
                    flat = np.concatenate([out[i] for i in pick]).view(np.int64)
                    offs = np.concatenate(([0], np.cumsum(n[pick]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["node", "items"])

    return run


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _id_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_slot(batch.column(0).to_numpy(zero_copy_only=False)))], names=["slot"])


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links).

    Words are runs of anything but space and U+0009..U+000D; A-Z are lower-cased and nothing else is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof = materialize(src.mapInArrow(_profile(k), f"doc_id long, n int, node long, {', '.join(f'{c} long' for c in PARITY)}, wide array<long>, piece int, task int, counts binary"), "profile")
    rows = prof.where("piece IS NULL").select("doc_id", "n", "node", *PARITY, "wide")
    nodes = rows.where("n > 0")
    small = nodes.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect()  # 48 rows at most
    light = choose_boundary({r["n"]: r["count"] for r in small}, num, den)
    levels = spark.sparkContext.broadcast(_sketch(prof.where("piece IS NOT NULL").select("piece", "task", "counts")))

    entries = materialize(src.select("text").mapInArrow(_lists(k, num, den, light, levels), "token long, node long, n int, pos int"), "entries")
    shared = entries.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least < last")
    found = materialize(entries.join(shared, "token"), "found")
    discard(entries)
    members = materialize(_with_heads(found, num, den), "members")
    discard(found)

    listed = members.select("node").distinct()
    odd = materialize(nodes.join(listed, "node", "left_semi").groupBy("node").agg(*[F.min(c).alias(c) for c in (*PARITY, "wide")]), "parities")
    verify = lambda pairs: _verify(src, nodes, pairs, odd, k, num, den)

    links, lists = None, members.withColumns({"comp": F.col("node"), "top": F.col("head.node")})
    for _ in range(ROUNDS):
        found = verify(_best_stars(lists, num, den))
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        discard(lists)
        lists = _open(members, comps)
    discard(members)
    open_lists, lists = lists, _with_earlier(lists).join(odd.drop("wide"), "node")
    own = ["node", "n", "pos", "comp", "earlier", *PARITY]
    left = lists.where("comp <> top").select("token", *[F.col(c).alias(f"l_{c}") for c in own])
    cross = (
        left.join(lists.select("token", *own), "token")
        .where("l_comp <> comp")
        .where(f"{den} * least(n, l_n) >= {num} * greatest(n, l_n)")
        .where(_overlap_bound("n", "pos", "l_n", "l_pos", num, den))
        .where(_difference_bound("n", "l_n", [(c, f"l_{c}") for c in PARITY], num, den))
        .where("NOT arrays_overlap(earlier, l_earlier)")
        .selectExpr("CASE WHEN node < l_node THEN node ELSE l_node END AS a", "CASE WHEN node < l_node THEN n ELSE l_n END AS an", "CASE WHEN node < l_node THEN l_node ELSE node END AS b", "CASE WHEN node < l_node THEN l_n ELSE n END AS bn")
        .distinct()
    )
    found = verify(cross)
    discard(open_lists, odd)
    comps = components(links.unionByName(found)).withColumnRenamed("component", "comp")

    node_comp = nodes.groupBy("node").agg(F.min("doc_id").alias("first")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = node_comp.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_node = node_comp.join(firsts, "comp").select("node", "component_id")
    # an empty set's node is shared by all empty texts: they get themselves, and go past the join
    return (
        nodes.join(by_node, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        .unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def _overlap_bound(n: str, p: str, m: str, q: str, num: int, den: int) -> str:
    """At the first shared shingle no more can be shared than stands from there on; subset keys (pos -1) always pass."""
    return f"({p} < 0 OR {q} < 0 OR {den + num} * cast(least({n} - {p}, {m} - {q}) as long) >= {num} * cast({n} + {m} as long))"


def _best_stars(members: DataFrame, num: int, den: int) -> DataFrame:
    """For each node outside its list's head component the head it meets in most lists: a pair (a, an, b, bn) for each node at most."""
    pairs = (
        members.where("comp <> top")
        .selectExpr("head.node AS a", "head.n AS an", "head.pos AS ap", "node AS b", "n AS bn", "pos AS bp")
        .where("a <> b")
        .where(f"{den} * least(an, bn) >= {num} * greatest(an, bn)")
        .where(_overlap_bound("an", "ap", "bn", "bp", num, den))
    )
    return pairs.groupBy("b", "bn", "a", "an").count().groupBy("b", "bn").agg(F.max(F.struct("count", "a", "an")).alias("m")).select(F.col("m.a").alias("a"), F.col("m.an").alias("an"), "b", "bn")


def _with_heads(found: DataFrame, num: int, den: int) -> DataFrame:
    """Members with their list's head. Lists of two nodes, mostly chance meetings, go if sizes or places rule a link out."""
    heads = found.groupBy("token").agg(
        F.min(F.struct("pos", "n", "node")).alias("head"), F.max(F.struct("pos", "n", "node")).alias("other"), 
        F.bool_or((F.col("node") != F.col("least")) & (F.col("node") != F.col("last"))).alias("more"),
    )
    fits = F.expr(f"{den} * least(head.n, other.n) >= {num} * greatest(head.n, other.n)") & F.expr(_overlap_bound("head.n", "head.pos", "other.n", "other.pos", num, den))
    return found.select("token", "node", "n", "pos").join(heads.where(F.col("more") | fits).select("token", "head"), "token")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of lists that hold several components, with comp, top (the list's largest component) and a head from that."""
    of = members.drop("head").join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tops = (
        of.groupBy("token", "comp").agg(F.count("*").alias("size"), F.min(F.struct("pos", "n", "node")).alias("head"))
        .groupBy("token").agg(F.max(F.struct("size", "comp", "head")).alias("t"), F.count("*").alias("parts"))
        .where("parts > 1").select("token", F.col("t.comp").alias("top"), F.col("t.head").alias("head"))
    )
    return materialize(of.join(tops, "token"), "open")


def _with_earlier(lists: DataFrame) -> DataFrame:
    """lists with earlier: the last BACK tokens of the node's own open lists before this one. The first list that two nodes
    share has none of the other's among them; most later ones do."""
    w = Window.partitionBy("node").orderBy("pos", "token").rowsBetween(-BACK, -1)
    none = F.array().cast("array<bigint>")
    return lists.withColumn("earlier", F.when(F.col("pos") < 0, none).otherwise(F.collect_list(F.when(F.col("pos") >= 0, F.col("token"))).over(w)))


def _difference_bound(n: str, m: str, parities: list[tuple[str, str]], num: int, den: int) -> str:
    """Sets whose parity bits differ in d places differ in d shingles at least; a link allows (den - num) / (den + num) of n + m."""
    d = " + ".join(f"bit_count({a} ^ {b})" for a, b in parities)
    return f"{den + num} * cast({d} as long) <= {den - num} * cast({n} + {m} as long)"


def _verify(src: DataFrame, nodes: DataFrame, pairs: DataFrame, odd: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection. Pairs whose parities show too many differences go first;
    of the others one text for each node is read again."""
    spark = src.sparkSession
    side = lambda s: odd.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in (*PARITY, "wide")])
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(_difference_bound("an", "bn", [(f"a_{c}", f"b_{c}") for c in PARITY], num, den)).where(_wide_bound(num, den))
    pairs = materialize(close.select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    readers = nodes.join(ends, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    slots = readers.select("doc_id").mapInArrow(_id_slots, "slot long").selectExpr("cast(shiftright(slot, 3) as int) AS byte", "shiftleft(1, cast(slot & 7L as int)) AS bit")
    got = slots.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()  # 2**19 rows at most
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bitmap[got["byte"].to_numpy(int)] = got["bits"].to_numpy(np.int64).astype(np.uint8)
    sets = src.mapInArrow(_wanted_sets(k, spark.sparkContext.broadcast(bitmap)), "node long, items array<long>").join(ends, "node", "left_semi")
    sets = materialize(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")
    links = materialize(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        .withColumn("o", F.size(F.array_intersect("x", "y")))
        .where(f"{den} * cast(o as long) >= {num} * (cast(size(x) as long) + size(y) - o)")
        .select("a", "b"),
        "links",
    )
    discard(pairs, sets)
    return links


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from caseloom.llm._common import table

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, all columns kept: that of the smallest doc_id, null ids last, of several such
    rows any one. Decided by row (a 64-bit hash of doc_id and text), so ids may repeat or be null; rows without words always stay."""
    key, many = unused(docs, "_key", "_many")
    row = F.xxhash64("doc_id", "text")
    comps = jaccard_components(docs.select(row.alias("doc_id"), "text"), k, num, den).where("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    of = docs.groupBy(row.alias("doc_id")).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    of = comps.join(of, "doc_id").select("component_id", "n", F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("key")).alias("rank"))
    of = materialize(of, "ranks")
    keep = of.groupBy("component_id").agg(F.min("rank").alias("keep"), F.max("rank").alias("last")).where("keep.key <> last.key").drop("last")
    gone = materialize(of.join(keep, "component_id").where("rank.key <> keep.key").select(F.col("rank.key").alias(key)), "gone")
    stay = docs.withColumn(key, row).join(gone, key, "left_anti")
    equal = of.where("n > 1").join(gone, F.col("rank.key") == F.col(key), "left_anti").select(F.col("rank.key").alias(key), F.lit(True).alias(many))
    if not equal.isEmpty():  # rows alike in id and text
        flagged = stay.join(equal, key, "left")
        stay = flagged.where(F.col(many).isNull()).unionByName(flagged.where(F.col(many)).dropDuplicates([key]))
    return stay.select(*docs.columns)
