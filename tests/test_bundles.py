import pytest
from pyspark.sql import functions as F

from caseloom.operators import bundles
from caseloom.plans import versions

REC = "typed_id string, thread_id string, kind string, author string, created_utc long, month string, title string, selftext string, body string, retrieved_at string, _bucket int"
MAY, JUNE, JULY, LATER = 10_400_000, 13_100_000, 15_700_000, 99_000_000


def rec(i, thread, utc, text="x", at="a"):
    post = i.startswith("t3_")
    month = {MAY: "1970-05", JUNE: "1970-06", JULY: "1970-07", LATER: "1973-02"}[utc]
    return (i, thread, "submissions" if post else "comments", "op", utc, month, None, text if post else None, None if post else text, at, 1)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "t")
    rows = [rec("t3_a", "t3_a", JUNE), rec("t1_a1", "t3_a", JUNE), rec("t1_a2", "t3_a", JULY), rec("t1_old", "t3_a", MAY), rec("t3_b", "t3_b", JULY), rec("t1_b1", "t3_b", JULY), rec("t3_z", "t3_z", MAY), rec("t1_late", "t3_a", LATER)]
    spark.createDataFrame(rows, REC).drop("_bucket").write.partitionBy("kind", "month").parquet(path)
    return spark.read.schema(", ".join(c for c in REC.split(", ") if not c.startswith("_bucket"))).parquet(path)


def test_context_reads_only_the_months_it_needs(spark, archive):
    seeds = spark.createDataFrame([rec("t1_a2", "t3_a", JULY), rec("t1_late", "t3_a", LATER)], REC)
    got, threads = bundles.collect_context(archive, seeds, archive.where("false"), "1970-07")
    assert sorted(r["typed_id"] for r in got.collect()) == ["t1_a1", "t1_a2", "t3_a"]  # not the comment older than its post, nor the one after the window
    assert [(r["thread_id"], r["containing_post_retrieved"], r["comments"], r["first_month"]) for r in threads.collect()] == [("t3_a", True, 2, "1970-06")]
    plan = archive.where((F.col("kind") == "comments") & (F.col("month") >= "1970-06") & (F.col("month") <= "1970-07"))
    assert len(plan.inputFiles()) >= 2 and plan._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(kind") == 1
    none, threads = bundles.collect_context(archive, seeds.where("false"), archive.where("false"), "1970-07")
    assert none.count() == threads.count() == 0
    lost = spark.createDataFrame([rec("t1_q", "t3_q", JULY), rec("t1_a2", "t3_a", JULY)], REC)
    got, threads = bundles.collect_context(archive, lost, archive.where("false"), "1970-07")  # a post that is not in the archive: all months
    assert {r["first_month"] for r in threads.collect()} == {None} and "t1_old" in {r["typed_id"] for r in got.collect()}


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_only_changed_cases_are_rewritten(spark, tmp_path):
    rows = [r for c in "abcdefgh" for r in (rec(f"t3_{c}", f"t3_{c}", JUNE), rec(f"t1_{c}1", f"t3_{c}", JULY))]
    hits = spark.createDataFrame([(f"t3_{c}",) for c in "abcdefgh"], "typed_id string")
    threads = spark.createDataFrame([("t3_a", True)], "thread_id string, comments_query_complete boolean")
    root = str(tmp_path / "state")

    def run(rows, hits=hits):
        head, members = bundles.post_bundles(spark.createDataFrame(rows, REC), hits, threads, "rev", "1970-07")
        return head, bundles.save_bundles(head, members, root, 32)

    head, first = run(rows)
    assert first["added"] == 8 and first["changed"] == 0
    before = files(tmp_path / "state")
    _, again = run([rec(*r[:2], r[4], r[7] or r[8], "later") for r in reversed(rows)])  # other order and time of retrieval
    assert again == {"added": 0, "changed": 0, "removed": 0, "unchanged": 8, "buckets_written": 0} and files(tmp_path / "state") == before
    edited = [r if r[0] != "t1_c1" else rec("t1_c1", "t3_c", JULY, "edited") for r in rows]
    _, third = run(edited)
    assert third == {"added": 0, "changed": 1, "removed": 0, "unchanged": 7, "buckets_written": 1}
    assert {n.split("/")[0] for n in set(files(tmp_path / "state")) - set(before)} == {"headers", "members"} and set(before) <= set(files(tmp_path / "state"))
    read = versions.read_state(spark, f"{root}/members", spark.createDataFrame(rows, REC).schema)
    assert sorted(r["body"] for r in read.where("kind = 'comments'").collect()) == ["edited"] + ["x"] * 7
    old = versions.read_state(spark, f"{root}/headers", head.schema, 1)  # an earlier version is still whole
    assert old.count() == 8 and old.join(head, ["incident_id", "content_hash"]).count() == 8
    _, gone = run(edited, hits.where("typed_id <> 't3_d'"))
    assert gone["removed"] == 1 and versions.read_state(spark, f"{root}/headers", head.schema).count() == 7


def test_an_interrupted_merge_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = lambda v: spark.createDataFrame([(i, v, v) for i in range(20)] + [(None, 0, 0)], "k int, h int, _was int")
    versions.merge_changed(rows(1), "k", "h", root, 4)
    put = versions.Folder.put
    monkeypatch.setattr(versions.Folder, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        versions.merge_changed(rows(2), "k", "h", root, 4)
    assert {r["h"] for r in versions.read_state(spark, root, rows(1).schema).collect()} == {1}
    monkeypatch.setattr(versions.Folder, "put", put)
    assert versions.merge_changed(rows(3), "k", "h", root, 4)["changed"] == 20
    got = versions.read_state(spark, root, rows(1).schema).collect()
    assert len(got) == 20 and {r["h"] for r in got} == {3}


def test_deleted_authors_and_null_times_have_no_history(spark):
    from caseloom.operators.cases import prior_activity

    rows = [(1, "a", 10, "c"), (2, "a", 20, "c"), (3, "a", None, "c"), (4, "a", 30, None), (5, "a", 40, "p"), (6, "[deleted]", 5, "c"), (7, "[deleted]", 6, "c"), (8, None, 7, "c"), (9, "a", 20, "p")]
    df = spark.createDataFrame(rows, "id int, author string, s int, kind string").withColumn("ts", F.timestamp_seconds("s")).withColumn("_us", F.lit("clash"))
    got = {r["id"]: (r["comments"], r["kinds_so_far"]) for r in prior_activity(df, "author", "ts", {"comments": "c"}, "kind").collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 1), 4: (2, None), 5: (2, 3), 6: (None, None), 7: (None, None), 8: (None, None), 9: (1, 2)}
