import hashlib
import os

import pytest
from pyspark.sql import functions as F

from caseloom.operators import cases, recovery
from caseloom.sources import manifest


@pytest.fixture()
def root(spark, tmp_path):
    path = str(tmp_path / "in (1)")
    spark.range(40).select("id", (F.col("id") % 2).alias("kind"), (F.col("id") % 4).alias("month")).repartition(1).write.partitionBy("kind", "month").parquet(path)
    return path


def touch(root, part, rows, spark):
    """Another content for the one file of a folder."""
    (name,) = [n for n in os.listdir(f"{root}/{part}") if n.endswith(".parquet")]
    new = f"{root}-new"
    spark.range(rows).write.mode("overwrite").parquet(new)
    (own,) = [n for n in os.listdir(new) if n.endswith(".parquet")][:1]
    os.replace(f"{new}/{own}", f"{root}/{part}/{name}")
    os.remove(f"{root}/{part}/.{name}.crc")  # of the old content
    os.utime(f"{root}/{part}/{name}", (1_000_000_000, 1_000_000_000))
    return f"{part}/{name}"


def test_digests_and_tree(spark, root):
    leaves = manifest.file_digests(spark, root).cache()
    got = {r["path"]: r["digest"] for r in leaves.collect()}
    assert len(got) == 4 and all(hashlib.sha256(open(f"{root}/{p}", "rb").read()).hexdigest() == d for p, d in got.items())
    nodes = {r["folder"]: r["files"] for r in manifest.tree(leaves).collect()}
    assert nodes == {"": 4, "kind=0": 2, "kind=1": 2, "kind=0/month=0": 1, "kind=0/month=2": 1, "kind=1/month=1": 1, "kind=1/month=3": 1}
    again = manifest.tree(manifest.file_digests(spark, root, known=leaves).repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.tree(leaves).collect()))
    run = manifest.artifact("r1", "v", "all", leaves, {"t": leaves}, ["none"]).first()
    assert run["inputs"]["files"] == 4 and run["outputs"][0]["rows"] == 4
    assert manifest.artifact("r1", "v", "all", leaves.where("false"), {}, []).first()["inputs"]["files"] == 0


def test_one_altered_file_is_named_and_the_others_are_not_read(spark, root):
    old = spark.createDataFrame(manifest.file_digests(spark, root).collect(), manifest.LEAF)
    changed = touch(root, "kind=1/month=3", 7, spark)
    lied = old.withColumn("digest", F.when(F.col("path") != changed, F.lit("kept")).otherwise(F.col("digest")))  # what is not read again keeps even this
    new = {r["path"]: r["digest"] for r in manifest.file_digests(spark, root, known=lied).collect()}
    assert [p for p, d in new.items() if d != "kept"] == [changed] and new[changed] == hashlib.sha256(open(f"{root}/{changed}", "rb").read()).hexdigest()
    assert [tuple(r) for r in manifest.changes(old, manifest.file_digests(spark, root, known=old)).collect()] == [(changed, "changed")]
    os.remove(f"{root}/{changed}")
    assert [tuple(r) for r in manifest.changes(old, manifest.file_digests(spark, root, known=old)).collect()] == [(changed, "removed")]
    assert manifest.changes(old, old).count() == 0


def test_reads_stay_on_the_manifest(spark, root):
    old = spark.createDataFrame(manifest.file_digests(spark, root).collect(), manifest.LEAF)
    spark.range(5).write.parquet(f"{root}/late")
    assert manifest.read_pinned(spark, root, old, "id long").count() == 40
    changed = touch(root, "kind=0/month=0", 9, spark)
    for verify in (False, True):
        with pytest.raises(manifest.Changed, match="month=0"):
            manifest.read_pinned(spark, root, old, "id long", verify)
    assert manifest.read_pinned(spark, root, old.where(F.col("path") != changed), "id long", True).count() == 30
    assert manifest.read_pinned(spark, root, old.where("false"), "id long").count() == 0


def test_links_of_a_long_text_and_odd_rows(spark):
    url = "https://redd.it/abc"
    text = "😀 " + f"my first post {url} " * 3000
    rows = [("t3_a", "t3_a", "submissions", "op", "op", text), ("t3_b", "t3_b", "submissions", "op", "op", None), ("t3_c", "t3_c", "submissions", "op", "op", ""), ("t3_abc", "t3_abc", "submissions", "op", "op", url), (None, None, "comments", None, None, url)]
    df = spark.createDataFrame(rows, "typed_id string, thread_id string, kind string, author string, original_author string, body string").withColumn("url", F.lit("clash"))
    got = cases.extract_links(df, "body").collect()
    assert len(got) == 3000 and all(text[r["url_start"] : r["url_end"]] == url and r["quote"] == text[max(0, r["url_start"] - 180) : r["url_end"] + 180] and r["supported"] for r in got)


def test_every_shard_state(spark):
    inventory = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "3"), ("d", None), ("e", "5"), ("f", "6"), ("g", "7"), ("i", "9")], "path string, content_identity string")
    done = [("a", "complete", 5, "1"), ("a", "failed", 9, "1"), ("c", "complete", 1, "other"), ("d", "complete", 1, None), ("e", "partial", 1, "5"), ("f", "failed", 0, "6"), ("h", "complete", 1, "8"), ("i", "partial", 2, "9"), ("i", "complete", 1, "9")]
    states = recovery.shard_states(inventory, spark.createDataFrame(done, "path string, status string, scanned long, content_identity string"))
    assert {r["path"]: r["current_status"] for r in states.collect()} == {"a": "complete", "b": "duplicated", "c": "changed", "d": "unverifiable", "e": "partial", "f": "failed", "g": "missing", "h": "source_unavailable", "i": "complete"}
    plan = {r["path"]: (r["action"], r["reason"]) for r in recovery.mode_plan(states, "incremental").collect()}
    assert plan == {"a": ("skip", "complete_and_compatible"), "b": ("skip", "same_content_as:a"), "c": ("scan", "changed"), "d": ("scan", "unverifiable"), "e": ("scan", "partial_restarts"), "f": ("scan", "failed"), "g": ("scan", "no_checkpoint"), "h": ("none", "source_unavailable"), "i": ("skip", "complete_and_compatible")}
    assert {r["action"] for r in recovery.mode_plan(states, "local_reuse").collect()} == {"reuse", "skip", "defer", "none"}
    with pytest.raises(ValueError):
        recovery.mode_plan(states, "some")


def test_table_functions_in_sql(spark):
    from caseloom.functions import tables

    tables.register_phrases(spark, spark.createDataFrame([("q", "my post"), ("r", "post")], "query_id string, normalized string"))
    tables.register_links(spark)
    df = spark.createDataFrame([(1, "😀 MY  Post, https://redd.it/ABC"), (2, None), (3, "")], "k int, t string")
    got = spark.sql("SELECT k, h.query_id, h.start, h.end, h.quote FROM {d}, LATERAL find_phrases(t) AS h", d=df).collect()
    assert sorted(map(tuple, got)) == [(1, "q", 2, 10, "MY  Post"), (1, "r", 6, 10, "Post")]
    assert [tuple(r) for r in spark.sql("SELECT k, l.url_start, l.thread_id FROM {d}, LATERAL thread_links(t) AS l", d=df).collect()] == [(1, 12, "t3_abc")]
