"""Prefix trie of conversations, built level by level, and what sharing prefixes saves.

A node of depth d is a distinct sequence of d turns (role, text); its members are the conversations that begin with it, and the
smallest conv_id among them, with d, names it. Turns are compared by SHA-256 of role and text.

Down: equal conversations are one first (their smallest conv_id stands for them, with their number). Then, depth by depth, live
conversations are grouped by (parent node, next turn) and take the smallest conv_id of their group as node; a conversation lives on
while another one shares its node. Aggregates combine before the shuffle, and the joins that hand the node back have no window, so a turn that most
conversations begin with is split by adaptive execution. A node of one conversation (or of equal ones) goes on as a chain to its end, whose nodes need
no grouping: all chains are laid out in one pass. So the rounds follow the deepest prefix that two different conversations share.

Up: from the deepest level to the root each level joins the sums of its children, leaves and saved tokens.

The order of turns inside a conversation comes from a sort by ranges and the counts of each range, not from a window over a
conversation, and sums along a chain from blocks of BLOCK turns, so a very long conversation is many tasks. The conv_ids that end in a node
are hashed in order, streaming: one task for each group of equal conversations, with bounded memory (SHA-256 can't be taken in parts).

Edge cases: null role and text are empty; null turns come first, equal turns are ordered by role, then text; repeated rows are repeated turns;
rows without conv_id take no part; a conversation that the rebuilding leaves without turns is a member of the root only; other columns are ignored;
an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm._common import discard, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_hash, words: turns in the order of turn, role, text."""
    spark = turns.sparkSession
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    # the role's length keeps role and text apart
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = placed.select("conv_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("id"), F.unhex(same).alias("turn_hash"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    placed = materialize(placed, "turns")
    runs = placed.groupBy("conv_id", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a conversation is one run in each range
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(runs.select("conv_id", "range", "first", before.alias("before")), ["conv_id", "range"]).select("conv_id", (F.col("before") + F.col("id") - F.col("first") + 1).alias("pos"), "turn_hash", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_hash, words) of the rebuilt conversations, and conv_id of all of them.

    Conversation c gets the first h = crc32(c) mod `most` turns of conversation c - c % every, then its own after its first h. turns: of ordered_turns."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    ids = turns.select("conv_id").distinct().withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "turn_hash", "words")
    head = ids.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "turn_hash", "words")
    got = heads.groupBy("base").agg(F.max("pos").alias("held"))  # fewer than `most`
    shift = ids.join(got, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("put"))
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("put")).alias("depth"), "turn_hash", "words")
    return head.unionByName(own), ids.select("conv_id")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined conv_ids of each run of equal rep; rows come sorted."""
    now, hashed = None, None
    for b in batches:
        done = []
        for rep, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if rep != now:
                if hashed:
                    done.append((now, hashed.hexdigest()))
                now, hashed = rep, hashlib.sha256(str(conv).encode())
            else:
                hashed.update(b",%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["rep", "ends"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hashed.hexdigest()], pa.string())], names=["rep", "ends"])


def equal_conversations(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, size, len, ends: groups of conversations with the same turns; rep is their smallest conv_id, ends the hash of their conv_ids.

    Two sums of independent 64-bit hashes of (depth, turn) stand for a sequence: nothing is gathered."""
    one = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("len"), one("depth", "turn_hash").alias("a"), one("turn_hash", F.lit("b"), "depth").alias("b"))
    whole = materialize(ids.join(whole, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "whole")
    groups = materialize(whole.groupBy("len", "a", "b").agg(F.min("conv_id").alias("rep"), F.count("*").alias("size")), "groups")
    many = whole.join(groups.where("size > 1").select("len", "a", "b", "rep"), ["len", "a", "b"]).select("rep", "conv_id")
    hashes = many.repartition("rep").sortWithinPartitions("rep", "conv_id").mapInArrow(_joined, "rep long, ends string")
    ends = F.when(F.col("size") == 1, F.sha2(F.col("rep").cast("string"), 256)).otherwise(F.col("ends"))
    out = materialize(groups.join(hashes, "rep", "left").select("rep", "size", "len", ends.alias("ends")), "sequences")
    discard(whole, groups)
    return out


def _suffix(turns: DataFrame) -> DataFrame:
    """rep, depth, words and after: the words of this turn and all that follow, from sums of blocks of turns."""
    turns = turns.withColumn("block", F.floor(F.col("depth") / BLOCK))
    blocks = turns.groupBy("rep", "block").agg(F.sum("words").alias("n"))
    later = F.coalesce(F.sum("n").over(W.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("words").over(W.partitionBy("rep", "block").orderBy(F.desc("depth")))
    return turns.withColumn("inside", inside).join(blocks.select("rep", "block", later.alias("later")), ["rep", "block"]).withColumn("after", F.col("inside") + F.col("later")).drop("inside", "later", "block")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes (NODE) of conversations (conv_id, depth from 1, turn_hash, words); ids has every conv_id, those without turns too."""
    spark = turns.sparkSession
    seqs = equal_conversations(turns, ids)
    if seqs.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    mine = turns.withColumnRenamed("conv_id", "rep").join(seqs.select("rep", "size", "len"), "rep")
    # by depth, so that each level reads its own rows
    mine = materialize(mine.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "depth", "rep").sortWithinPartitions("depth", "rep"), "sequence-turns")
    top = seqs.agg(F.min("rep").alias("node"), F.count("*").alias("seqs"), F.sum("size").alias("n_convs")).withColumns({"parent": F.lit(None).cast("long"), "words": F.lit(0)})
    levels = [materialize(top, "level")]
    placed = [materialize(seqs.join(F.broadcast(top.select("node", "seqs")), F.lit(True)).select("rep", "node", "seqs", "len"), "placed")]  # top is one row
    while True:
        at = len(levels)
        live = placed[-1].where((F.col("seqs") > 1) & (F.col("len") >= at)).select("rep", F.col("node").alias("parent"))
        if live.isEmpty():
            break
        step = live.join(mine.where(F.col("depth") == at), "rep").select("rep", "parent", "turn_hash", "words", "size", "len")
        step = materialize(step, "step")
        found = step.groupBy("parent", "turn_hash").agg(F.min("rep").alias("node"), F.count("*").alias("seqs"), F.sum("size").alias("n_convs"), F.max("words").alias("words"))
        found = materialize(found, "level")
        levels.append(found)
        placed.append(materialize(step.join(found.select("parent", "turn_hash", "node", "seqs"), ["parent", "turn_hash"]).select("rep", "node", "seqs", "len"), "placed"))
        discard(step)
    chains, ends = _chains(levels, placed, mine, seqs)
    out, below = chains, None
    for at in range(len(levels) - 1, -1, -1):
        below = materialize(_rolled(levels[at], at, below, ends), "rolled")
        out = out.unionByName(below)
    discard(*placed, *levels, ends, mine, seqs)
    return out.select(*NODE)


def _chains(levels: list[DataFrame], placed: list[DataFrame], mine: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes below those of one sequence, each the only child of the one before; and (node, at, ends, chain_saved): what ends in a level's node, and what the chain below it saves."""
    alone = ended = None
    for at, (level, put) in enumerate(zip(levels, placed, strict=True)):
        part = level.where("seqs = 1").select(F.col("node").alias("rep"), F.lit(at).alias("top"))
        last = put.where(F.col("len") == at).select("rep", "node", F.lit(at).alias("at"))
        alone, ended = (part, last) if alone is None else (alone.unionByName(part), ended.unionByName(last))
    alone = materialize(alone, "alone")
    long = _suffix(mine).join(alone, "rep")
    last = F.col("depth") == F.col("len")
    nodes = long.where("depth > top").join(seqs.select("rep", "ends"), "rep").select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("size").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("size") - 1) * F.col("after")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(NONE)).alias("ends_sha256"),
    )
    nodes = materialize(nodes, "chains")
    # of a level's node of one sequence: what its chain below saves
    below = nodes.join(alone, (F.col("conv_id") == F.col("rep")) & (F.col("depth") == F.col("top") + 1)).select(F.col("rep").alias("node"), F.col("top").alias("at"), F.col("saved_tokens").alias("chain_saved"))
    ends = ended.join(seqs.select("rep", "ends"), "rep").drop("rep")
    return nodes, materialize(ends.join(below, ["node", "at"], "full"), "ends")


def _rolled(level: DataFrame, at: int, below: DataFrame | None, ends: DataFrame) -> DataFrame:
    """One level's nodes with what their subtrees hold: children of the level below, or a chain."""
    own = level.join(ends.where(F.col("at") == at).drop("at"), "node", "left")
    if below is None:
        own = own.withColumns({"children": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
    else:
        sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        own = own.join(sums.withColumnRenamed("parent_conv_id", "node"), "node", "left")
    chain = F.col("chain_saved").isNotNull()
    children = F.coalesce("children", F.when(chain, 1).otherwise(0)).cast("long")
    return own.select(
        F.col("node").alias("conv_id"), F.lit(at).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", children.alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", "chain_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
    )


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = materialize(ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "ordered")
    return trie(*rebuilt(turns))


def _bits(x: Column | str) -> str:
    return f"list_reduce(list_concat([4294967295], flatten([[ord(substr({x}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, length({x}) + 1)])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"


# crc32 by its definition, eight shifts a byte
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, xor({_bits("conv_id::VARCHAR")}, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
  SELECT i.conv_id, t.pos AS o, 0 AS own, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.pos <= i.h
  UNION ALL SELECT i.conv_id, t.pos, 1, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.pos > i.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, o) AS d, sha256(length(role)::VARCHAR || ':' || role || text) AS s, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM b
), lists AS (SELECT conv_id, list(s ORDER BY d) AS l FROM turns GROUP BY conv_id),
prefixes AS (
  SELECT i.conv_id, d, sha256(array_to_string(l[1:d], ',')) AS k, d = coalesce(len(l), 0) AS last
  FROM ids i LEFT JOIN lists USING (conv_id), unnest(range(0, coalesce(len(l), 0) + 1)) AS u(d)
), nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM prefixes GROUP BY d, k
), own AS (
  SELECT n.*, p.conv_id AS parent, coalesce((n.n - 1) * w.words, 0) AS saved
  FROM nodes n LEFT JOIN prefixes up ON up.conv_id = n.conv_id AND up.d = n.d - 1 LEFT JOIN nodes p ON p.d = up.d AND p.k = up.k
  LEFT JOIN turns w ON w.conv_id = n.conv_id AND w.d = n.d
), children AS (SELECT parent, d - 1 AS d, count(*) AS c FROM own WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT o.*, coalesce(c, 0) AS c FROM own o LEFT JOIN children x ON x.parent = o.conv_id AND x.d = o.d),
subtree AS (
  SELECT a.d, a.k, count(*) FILTER (m.c = 0) AS leaves, sum(m.saved) AS saved
  FROM full_nodes m JOIN prefixes a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.d, a.k
)
SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.c AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN subtree s USING (d, k)
"""
