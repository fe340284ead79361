"""The graph of explicit links: components, bounded expansion, originals and coverage of cases.

Edges are explicit URLs between threads only; nothing here joins authors or accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.state import resume_key
from caseloom.plans.scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node reachable.

    Alternating star contraction: every node sends its larger neighbours, then its smaller ones, to the smallest node
    it knows, until all edges point at a root. Rounds grow with the logarithm of the longest path, all aggregates
    combine before the shuffle. Null ends and loops are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        far = written(far, "far")
        root = far.groupBy("a").agg(F.min("b").alias("m"))
        near = far.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(near.union(root.toDF("a", "b")).where("a <> b").distinct(), "near")
        discard(e, far)
        tangled = new.groupBy("a").count().where("count > 1").limit(1).union(new.join(new.select(F.col("b").alias("a")), "a", "left_semi").groupBy("a").count().limit(1))
        e = new
        if tangled.isEmpty():
            return e.union(e.select("b", "b").distinct()).toDF("node", "component")


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int, max_posts: int) -> DataFrame:
    """(thread, depth): seed threads at depth 0 and targets of their supported links, at most max_posts in all.

    When a round finds more than fit, the smallest ids go in; a round that finds nothing new ends the walk.
    """
    found = written(seeds.select("thread").where("thread IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "frontier")
    links = edges.where("supported").select("source_thread", F.col("target_thread").alias("thread")).distinct()
    for depth in range(1, max_depth + 1):
        room = max_posts - found.count()
        if room <= 0:
            break
        last = found.where(F.col("depth") == depth - 1).select(F.col("thread").alias("source_thread"))
        new = links.join(last, "source_thread", "left_semi").select("thread").distinct().join(found, "thread", "left_anti")
        new = written(new.orderBy("thread").limit(room).withColumn("depth", F.lit(depth)), "frontier")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def case_threads(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_key, thread): the case's own thread and all threads of its component under supported links. cases: seed_key, thread."""
    comp = components(edges.where("supported").select(F.col("source_thread").alias("a"), F.col("target_thread").alias("b")))
    own = cases.join(comp.toDF("thread", "component"), "thread", "left")
    more = own.where("component IS NOT NULL").select("seed_key", "component").join(comp, "component").select("seed_key", F.col("node").alias("thread"))
    return own.select("seed_key", "thread").union(more).distinct()


def originals(cases: DataFrame, members: DataFrame, posts: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_key, original_post_id, status): the first post, by time and id, that an earlier-pointing link of the case names, else the seed thread."""
    earlier = edges.where("relationship IN ('points_to_earlier_post', 'attributed_crosspost')").select(F.col("source_thread").alias("thread"), "target_thread")
    named = members.join(earlier, "thread").select("seed_key", F.col("target_thread").alias("thread")).distinct()
    at = posts.select(F.col("typed_id").alias("thread"), F.coalesce("created_utc", F.lit(0)).alias("t"))
    first = named.join(members, ["seed_key", "thread"], "left_semi").join(at, "thread").groupBy("seed_key").agg(F.min(F.struct("t", "thread")).alias("f"))
    own = posts.select(F.col("typed_id").alias("thread"), F.lit(True).alias("held"))
    out = cases.join(first, "seed_key", "left").join(own, "thread", "left")
    original = F.coalesce(F.col("f.thread"), F.when(F.col("held"), F.col("thread")))
    return out.select("seed_key", original.alias("original_post_id"), F.when(original.isNotNull(), "provisional seed thread").otherwise("unresolved").alias("status"))


def coverage(members: DataFrame, records: DataFrame) -> DataFrame:
    """Per case: retrieved posts and comments, missing posts and parents, deleted or removed comments. A case never counts as complete.

    records: typed_id, thread_id, parent_id, kind, body. Parents are looked up in the case's own records.
    """
    rows = members.join(records.withColumnRenamed("thread_id", "thread"), "thread")
    ids = rows.select("seed_key", F.col("typed_id").alias("parent_id"), F.lit(1).alias("here"))
    lost = rows.where("kind = 'comments' AND parent_id IS NOT NULL").select("seed_key", "parent_id").distinct().join(ids, ["seed_key", "parent_id"], "left_anti").groupBy("seed_key").agg(F.count("*").alias("missing_parents"))
    held = rows.groupBy("seed_key").agg(
        F.count_if(F.col("kind") == "submissions").alias("posts"),
        F.count_if(F.col("kind") == "comments").alias("comments"),
        F.count_if((F.col("kind") == "comments") & F.col("body").isin("[deleted]", "[removed]")).alias("deleted_or_removed"),
    )
    threads = members.groupBy("seed_key").agg(F.count("*").alias("threads"))
    out = threads.join(held, "seed_key", "left").join(lost, "seed_key", "left").fillna(0)
    return out.select("seed_key", "threads", "posts", "comments", (F.col("threads") - F.col("posts")).alias("missing_posts"), "missing_parents", "deleted_or_removed", F.lit(False).alias("complete_case"))


def incident_id(revision: str, key: Column) -> Column:
    return F.concat(F.lit("i_"), F.substring(resume_key(F.lit(revision), key), 1, 20))


def content_hash(members: DataFrame, records: DataFrame, skip: tuple[str, ...] = ("retrieved_at",)) -> DataFrame:
    """(seed_key, content_hash) over a case's records but for the skipped columns, whatever their order. Sums combine before the shuffle."""
    cols = [c for c in records.columns if c not in skip]
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(F.col("h"), i, 12), 16, 10).cast("decimal(38,0)"))
    rows = records.select(F.col("thread_id").alias("thread"), row.alias("h"))
    sums = members.join(rows, "thread").groupBy("seed_key").agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in (1, 13, 25, 37)])
    return sums.select("seed_key", F.sha2(F.concat_ws(":", "n", "s1", "s13", "s25", "s37"), 256).alias("content_hash"))
