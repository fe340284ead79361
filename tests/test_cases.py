import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caseloom.operators import annotations as an
from caseloom.operators import exports, graph, recovery, review
from caseloom.plans import ledger
from caseloom.sources import archive, workbook


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n, m", [(60, 45), (40, 200), (30, 0)])
def test_components_equal_union_find(spark, n, m):
    r = random.Random(n)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(None, 1), (3, 3)] + [(100 + i, 101 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = graph.components(spark.createDataFrame(edges, "a int, b int"))
    assert dict(rows(got)) == {x: find(x) for x in up}


def test_expansion_is_bounded_and_stops(spark):
    e = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("b", "d", True), ("d", "a", True), ("c", "x", False)], "source_thread string, target_thread string, supported boolean")
    seeds = spark.createDataFrame([("a",), (None,)], "thread string")
    assert rows(graph.expand(seeds, e, 5, 10)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.expand(seeds, e, 5, 2)) == [("a", 0), ("b", 1)]
    assert rows(graph.expand(seeds, e, 1, 10)) == [("a", 0), ("b", 1), ("c", 1)]


def test_content_hash_ignores_order_and_retrieval_time(spark):
    m = spark.createDataFrame([("s", "t")], "seed_key string, thread string")
    schema = "typed_id string, thread_id string, body string, retrieved_at int"
    a, b, c = ([("1", "t", "x", 1), ("2", "t", None, 1)], [("2", "t", None, 9), ("1", "t", "x", 9)], [("1", "t", "y", 1), ("2", "t", None, 1)])
    ha, hb, hc = (rows(graph.content_hash(m, spark.createDataFrame(x, schema))) for x in (a, b, c))
    assert ha == hb != hc


@pytest.mark.parametrize("capacity", [1, 7, 30])
def test_batches_are_greedy(spark, capacity):
    r = random.Random(capacity)
    items = [(str(c), i, r.randrange(12)) for c in range(5) for i in range(r.randrange(40))]
    want, case = [], None
    for c, i, s in items:
        if c != case:
            case, batch, used, some = c, 0, 0, False
        if some and used + s > capacity:
            batch, used = batch + 1, 0
        used, some = used + s, True
        want.append((c, i, s, batch))
    assert rows(an.batches(spark.createDataFrame(items, "case_id string, place int, size int"), capacity)) == sorted(want, key=repr)


def test_quotes_are_found_in_code_points_and_checked(spark):
    recs = spark.createDataFrame([("t3_1", "t3_1", "u", 5, "😀 it was me", None), ("t1_2", "t3_1", None, None, None, "no")], "typed_id string, thread_id string, author string, created_utc long, selftext string, body string")
    texts = an.long_fields(recs, ("selftext", "body"))
    q = spark.createDataFrame([("e1", "t3_1", "selftext", "was"), ("e2", "t3_1", "selftext", "absent"), ("e3", "t9", "body", "x"), ("e4", "t1_2", "body", "no"), ("e5", "t1_2", "body", "")], "evidence_id string, source_record_id string, source_field string, quote string")
    found = an.locate_quotes(q, texts)
    assert {r["evidence_id"]: (r["raw_start"], r["raw_end"]) for r in found.collect()} == {"e1": (5, 8), "e2": (None, None), "e3": (None, None), "e4": (0, 2), "e5": (None, None)}
    assert rows(an.span_violations(found, texts)) == [("e2", "quote_or_offset"), ("e3", "outside_bundle"), ("e5", "quote_or_offset")]


def test_valid_annotation_breaks_no_rule(spark):
    ev = [("e1", "t3_1", "t3_1", "body", 0, 1, "x", None, None)]
    good = ("i1", "h", "Yes", "reviewed", "r", ev, ["e1"], {"label": ["e1"]}, [], None, None)
    bad = ("i2", "h", "Yes", "pending_x", "r", None, ["e9"], {"label": []}, ["stranger"], 2, None)
    got = rows(an.violations(spark.createDataFrame([good, bad], an.ANNOTATION)))
    assert {g[0] for g in got} == {"i2"} and len(got) == 5


def test_segments_cover_every_character(spark):
    texts = ["", None, "a" * 161, "😀" * 1000, "b" * 341]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", an.segments(F.col("t"), 350).alias("s")).collect():
        t = texts[r["i"]] or ""
        assert all(t[s["raw_start"] : s["raw_end"]] == s["text"] for s in r["s"])
        assert set().union(*(range(s["raw_start"], s["raw_end"]) for s in r["s"])) == set(range(len(t)))


def test_numbers_are_global_and_parts_bounded(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert rows(exports.numbered(df, ["x"])) == sorted(((i, i + 1) for i in range(1000)), key=repr)
    got = rows(exports.part_ranges({"a": spark.range(7), "b": spark.range(4)}, 3))
    assert [r[1:] for r in got if r[0] == "a"] == [(1, 1, 3), (2, 4, 6), (3, 7, 7)]
    assert [r[1:] for r in got if r[0] == "b"] == [(1, 1, 3), (2, 4, 4), (3, None, None)]


def test_workbook_round_trip_and_phrases(spark, tmp_path):
    content = workbook.workbook_bytes({"All <&> first": (["Id", "Search Phrase"], [[1, "my post "], [2.5, None], [None, "=a & <b>"]]), "Other": (["x"], [["y"]])})
    (tmp_path / "k.xlsx").write_bytes(content)
    cells = workbook.read_workbooks(spark, str(tmp_path))
    got = {(r["sheet"], r["row"]): r["cells"] for r in cells.collect()}
    assert got["All <&> first", 2] == {"A": "1", "B": "my post "} and got["All <&> first", 4] == {"B": "=a & <b>"} and got["Other", 2] == {"A": "y"}
    assert [r[2:] for r in rows(workbook.phrases(cells))] == [(2, "my post "), (4, "=a & <b>")]


def test_formula_cells_are_escaped():
    text = archive.csv_text(["a"], [["=1"], [" -x"], ["ok"], [{"b": [1]}], [None]])
    assert text.split("\r\n") == ["﻿a", "'=1", "' -x", "ok", '"{""b"": [1]}"', '""', ""]


def test_bad_ids_are_set_aside_and_unknown_paths_refused(spark):
    raw = spark.createDataFrame([("1", "t3_9", "t1_8"), ("2", "t1_9", None), (None, "t3_9", None), ("b!", "9", None)], "id string, link_id string, parent_id string")
    good, bad = archive.canonical(raw, "comments", "s")
    assert [r["canonical_permalink"] for r in good.collect()] == ["s/comments/9/_/1/"] and bad.count() == 3
    m = spark.createDataFrame([("a", "comments", "2010-01"), ("b", "submissions", "2010-01"), ("c", "submissions", "2011-01")], "path string, kind string, month string")
    assert [r["path"] for r in archive.select_files(m).collect()] == ["c", "b", "a"]
    assert [r["path"] for r in archive.select_files(m, kinds=[], end="2010-12").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        archive.select_files(m, paths=["a", "z"])


def test_command_line_discovers_resumes_and_stops(spark, tmp_path):
    from caseloom.__main__ import main

    src, out = tmp_path / "data", str(tmp_path / "out")
    for kind, col in (("submissions", "selftext"), ("comments", "body")):
        df = spark.createDataFrame([("1", "t3_1", "I lost my post"), ("2", "t3_1", "none")], f"id string, link_id string, {col} string")
        df.coalesce(1).write.parquet(str(src / kind / "2010" / "01"))
    (tmp_path / "k.xlsx").write_bytes(workbook.workbook_bytes({"S": (["Search Phrase"], [["My  Post"], ["my post"]])}))
    assert main(["inventory", "--source", str(tmp_path), "--out", out]) == 0
    assert main(["import-keywords", "--source", str(tmp_path / "k.xlsx"), "--out", out]) == 0
    assert main(["discover", "--out", out, "--bytes", "1"]) == 2
    assert main(["discover", "--out", out]) == 0 and main(["discover", "--out", out, "--seconds", "0"]) == 0
    assert sorted(r["typed_id"] for r in spark.read.parquet(f"{out}/hits").collect()) == ["t1_1", "t3_1"]
    assert spark.read.parquet(f"{out}/phrases").count() == 1
    assert main(["export", "--out", out, "--revision", "r"]) == 0 and main(["report", "--out", out]) == 0
    assert spark.read.json(f"{out}/export/hits_jsonl").select("hit_id").distinct().count() == 2 == spark.read.option("header", True).csv(f"{out}/export/hits_csv").count()
    text = "\n".join(r["value"] for r in spark.read.text(f"{out}/report").collect())
    assert "| comments | 1 |" in text and "| submissions | 1 |" in text


def test_failed_groups_are_tried_again_within_bounds():
    tries = []

    def work(g):
        tries.append(g)
        if g == "bad" or (g == "once" and tries.count("once") < 2):
            raise OSError

    done, failed, why = recovery.run_groups(["a", "once", "bad"], work, lambda g: 1, recovery.Budget())
    assert (sorted(done), failed, why) == (["a", "once"], ["bad"], None) and tries.count("bad") == 3
    assert recovery.run_groups(["a", "b"], lambda g: None, lambda g: 6, recovery.Budget(bytes=10)) == (["a"], ["b"], "bytes")
    with pytest.raises(KeyError):
        recovery.run_groups(["a"], {}.__getitem__, lambda g: 1, recovery.Budget())


def test_conflicting_events_and_final_views(spark):
    ev = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "event_id int, decision string")
    good, bad = review.import_events(ev)
    assert rows(good) == [(1, "a"), (3, None)] and rows(bad) == [(2,)]
    c = spark.createDataFrame([(i,) for i in range(5)], "record_id int")
    v = spark.createDataFrame([(0, "Yes", "decided"), (1, "No", "decided"), (2, None, "pending"), (3, "Unsure", "decided")], "record_id int, decision string, state string")
    m = spark.createDataFrame([(4, "Yes"), (1, "Yes")], "record_id int, label string")
    assert rows(review.final_views(c, v, m)) == [(0, "included", "human_decision"), (1, "excluded", "human_decision"), (2, "pending", "conflicting_decisions"), (3, "pending", "human_unsure"), (4, "pending", "model_label_only")]
    with pytest.raises(ValueError):
        review.screen(c, {"teen_age": F.lit(True)}, {})


def test_whole_groups_share_a_split(spark):
    d = spark.range(3000).select((F.col("id") % 300).alias("g")).withColumn("s", review.split_of(F.col("g"), "x", {"train": 50, "test": 50}))
    by = d.groupBy("g").agg(F.countDistinct("s").alias("n"), F.first("s").alias("s")).collect()
    assert all(r["n"] == 1 for r in by) and 100 < sum(r["s"] == "train" for r in by) < 200


def test_phrases_below_a_title_row(spark, tmp_path):
    from caseloom.sources import workbook

    (tmp_path / "a.xlsx").write_bytes(workbook.workbook_bytes({"General": (["A title"], [[None, None], ["n", "Search Phrase"], [1, "found me"], [2, ""], [3, "Search Phrase"]])}))
    cells = workbook.read_workbooks(spark, str(tmp_path))
    assert sorted((r["row"], r["phrase"]) for r in workbook.phrases(cells).collect()) == [(4, "found me"), (6, "Search Phrase")]


def test_resume_keys_tell_nulls_apart(spark):
    from caseloom.operators.state import resume_key

    none = F.lit(None).cast("string")
    keys = spark.range(1).select(*[resume_key(*p).alias(f"k{i}") for i, p in enumerate(([F.lit("a"), none, F.lit("b")], [F.lit("a"), F.lit("b")], [F.lit("a"), F.lit("b"), none], [F.lit("a"), F.lit(""), F.lit("b")], [F.lit("a"), F.lit("null"), F.lit("b")]))]).first()
    assert len(set(keys)) == 5


def test_failed_spark_jobs_are_tried_again(spark):
    from caseloom.operators import recovery

    tries = []

    def work(g):
        tries.append(g)
        spark.range(1).select(F.when(F.lit(g == "b" and tries.count("b") < 2), F.raise_error(F.lit("x"))).otherwise("")).collect()

    assert recovery.run_groups(["a", "b", "c"], work, lambda g: 1, recovery.Budget()) == (["a", "c", "b"], [], None)
    with pytest.raises(Exception, match="no_such_column"):
        recovery.run_groups(["a"], lambda g: spark.range(1).select("no_such_column"), lambda g: 1, recovery.Budget())


def test_preservation_within_a_case(spark):
    from caseloom.operators import cases

    post = "An original post of more than a hundred characters, which is repeated by others in full. " * 2
    rows = [("c", "t3_a1", "t3_a1", "submissions", "op", f" {post}\n", None), ("c", "t1_x", "t3_a1", "comments", "AutoModerator", None, f"> {post} <"), ("c", "t1_y", "t3_a1", "comments", "u", None, "preserved here"),
            ("c", "t3_b2", "t3_b2", "submissions", "v", f"original post by a1 on reddit, {post[:50]}", None), ("c", "t1_z", "t3_b2", "comments", "u", None, "preserved but elsewhere"), ("d", "t3_c3", "t3_c3", "submissions", "w", None, None), ("d", "t1_w", "t3_c3", "comments", "u", None, post)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "seed_key string, typed_id string, thread_id string, kind string, author string, selftext string, body string, created_utc long")
    got = {(r["post_id"], r["source_record_id"], r["type"], r["completeness"]) for r in cases.preservation(df).collect()}
    assert got == {
        ("t3_a1", "t1_x", "subreddit automod in comments", "full"), ("t3_a1", "t1_y", "another Redditor in comments", "unknown"), ("t3_a1", "t3_b2", "another subreddit", "unknown"),
        ("t3_b2", "t1_z", "another Redditor in comments", "unknown"), ("t3_c3", None, "none observed", None),
    }


def test_snapshot_fails_on_counts_that_cannot_be(spark):
    from caseloom.operators import summaries

    bad = spark.createDataFrame([("submissions", "complete", 3, 5)], "kind string, status string, scanned long, candidates long")
    with pytest.raises(Exception, match="do not add up"):
        summaries.snapshot(bad).collect()
    assert summaries.snapshot(bad.limit(0)).count() in (0, 1)


def test_round_robin_takes_strata_in_turn(spark):
    from caseloom.operators import selection

    g = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5)], "s string, id int")
    assert [r["id"] for r in selection.round_robin(g, ["s"], "id", 4).orderBy("place").collect()] == [5, 1, 4, 2]


def test_conflicts_among_all_events_are_counted(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    ev = [
        (1, 7, "a", at(3)), (4, 7, "b", at(3)), (7, 7, "b", at(4)), (10, 7, "b", at(4, 30)),  # three contents
        (2, 7, "a", at(3)), (5, 7, "a", at(3, 59)),  # copies
        (3, 7, "a", at(3)),  # once
        (1, 8, None, at(3)), (4, 8, "a", at(3)), (2, 8, "a", None), (5, 8, "a", at(0)), (3, 8, None, None), (6, 8, None, None), (9, 8, None, at(1)),
        (40, 9, "a", at(1)), (80, 9, "a", at(1)), (160, 9, "b", at(1)), (121, 9, "b", at(1)),
        (1, None, "a", at(1)), (4, None, "b", at(1)),
    ]
    t = pa.table({"event_id": pa.array([e[0] for e in ev], pa.int64()), "user_id": pa.array([e[1] for e in ev], pa.int64()), "event_type": [e[2] for e in ev], "ts": pa.array([e[3] for e in ev], pa.timestamp("us"))})
    pq.write_table(t, tmp_path / "events.parquet")
    events = duckdb.connect()
    events.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    out = ledger.c3_conflicting_events(spark, str(tmp_path))
    assert {r["event_id"] for r in out.collect()} == {701, 800, 801, 802, 901, None}
    got = rows(out.select("event_id", "contents"))
    assert got == sorted(events.sql(f"SELECT event_id, contents FROM ({ledger.ORACLE['c3_conflicting_events']})").fetchall(), key=repr)
    assert got == sorted([(701, 3), (801, 2), (802, 2), (800, 2), (901, 2), (None, 2)], key=repr)
