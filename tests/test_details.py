import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from caseloom.operators import export_tables, exports, selection, summaries
from caseloom.plans import details


def test_maps_merge_and_bounds_hold(spark):
    df = spark.createDataFrame([({"a": "1", "b": None}, {"b": "2", "c": None}), (None, {"x": "1"}), ({"x": "1"}, None), (None, None)], "a map<string,string>, b map<string,string>")
    assert [r[0] for r in df.select(selection.merged(F.col("a"), F.col("b"))).collect()] == [{"a": "1", "b": "2", "c": None}, {"x": "1"}, {"x": "1"}, {}]
    n = spark.createDataFrame([(None,), (-5.0,), (5.0,), (5000.0,)], "v double").select(selection.clamp(F.col("v"), 1, 900).alias("c")).collect()
    assert [r["c"] for r in n] == [None, 1, 5, 900]
    assert spark.range(1).select(selection.file_name(F.lit("Keyword hits Part 2"))).first()[0] == "keyword_hits_part_2"


def test_memberships_make_no_submission_up(spark):
    r = spark.createDataFrame([("t3_a", "t3_a", "submissions"), ("t1_a", "t3_a", "comments"), ("t1_a", "t3_a", "comments"), ("t1_b", "t3_b", "comments"), ("t1_n", None, "comments")], "typed_id string, thread_id string, kind string")
    got = {x["record_id"]: x["post_id"] for x in selection.memberships("r", "s", F.lit("why"), r).collect()}
    assert got == {"t3_a": "t3_a", "t1_a": "t3_a", "t1_b": None, "t1_n": None} and selection.memberships("r", "s", F.lit("why"), r.where("false")).count() == 0


def test_failed_classifications_have_no_label(spark):
    d = spark.createDataFrame([(1, "Yes", "completed", None, 0.9), (2, "Unsure", "completed", None, None), (3, "Yes", "failed", "timeout", 0.9), (4, None, None, None, None), (5, None, "completed", "x", None)], "record_id int, label string, status string, error string, score double")
    got = {r["record_id"]: tuple(r)[1:] for r in selection.classifications(d).collect()}
    assert got == {1: ("Yes", "completed", None, 0.9, "uncalibrated"), 2: ("Uncertain", "completed", None, None, "none"), 3: (None, "failed", "timeout", None, "none"), 4: (None, "not_run", None, None, "none"), 5: ("Uncertain", "completed", None, None, "none")}


def test_tables_of_sources_without_columns(spark):
    assert export_tables.codebook_table(spark).count() == 10 + 7 + 13 + 5 + 15 + 6 + 3
    a = export_tables.availability_table(spark).collect()
    assert len(a) == 85 and {r["availability"] for r in a} == {export_tables.EXTRA, export_tables.DIRECT, export_tables.UNAVAILABLE, export_tables.OWN}
    r = spark.createDataFrame([("t1_a", "t3_a", "comments", None)], "typed_id string, thread_id string, kind string, body string")
    row = export_tables.comments_table(r).first()
    assert row["comment_id"] == "t1_a" and row["permalink"] is None and export_tables.run_coverage_table(r).first()["stage"] is None
    hits = spark.createDataFrame([("h", "gone")], "hit_id string, query_id string")
    assert export_tables.hits_table(hits, spark.createDataFrame([], "query_id string, sheet string, row int")).first()["query_memberships"] == ""


def test_small_summaries_of_odd_rows(spark):
    p = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, ""), ("c", 2, None)], "sheet string, row int, normalized string")
    assert {r["sheet"]: (r["nonempty_phrases"], r["own"]) for r in summaries.phrases_per_sheet(p).collect()} == {"a": (2, 0), "b": (2, 1)}
    b = spark.createDataFrame([("f", "é", None), ("f", None, "ab"), (None, "x", "")], "path string, t string, u string")
    assert {r["path"]: r["payload_bytes"] for r in summaries.bytes_by_source(b, "path", ["t", "u"]).collect()} == {"f": 4, None: 1}
    t = spark.createDataFrame([("t3_a",), ("t3_a",), ("t3_z",)], "thread_id string")
    rec = spark.createDataFrame([("t3_a", "t3_a", "submissions"), ("t1_b", "t3_a", "comments")], "typed_id string, thread_id string, kind string")
    assert sorted(map(tuple, summaries.retrieval_of(t, rec).collect())) == [("t3_a", True, 1), ("t3_z", False, 0)]


def test_row_numbers_beside_columns_of_the_same_names(spark):
    df = spark.range(50).withColumns({"_range": F.lit("r"), "_rn": F.lit("n"), "_before": F.lit("b")})
    got = exports.numbered(df, ["id"]).orderBy("id").collect()
    assert [r["row_number"] for r in got] == list(range(1, 51)) and {(r["_range"], r["_rn"], r["_before"]) for r in got} == {("r", "n", "b")}


def test_first_rows_of_a_table_of_many_files(spark, tmp_path):
    def write(at, sizes):
        folder, n = tmp_path / at / "documents.parquet", 0
        folder.mkdir(parents=True)
        for i, size in enumerate(sizes):
            t = pa.table({"doc_id": pa.array(range(n + size, n, -1), pa.int64()), "text": pa.array([None if k % 3 == 0 else f"text {k}" for k in range(size)], pa.string())})
            pq.write_table(t, folder / f"part-{i:04}.parquet", row_group_size=2)
            n += size
        want = duckdb.sql(details.ORACLE["s4_first_rows"].replace("documents", f"'{folder}/*.parquet'")).fetchall()
        assert [tuple(r) for r in details.s4_first_rows(spark, str(tmp_path / at)).collect()] == want
        return [r[0] for r in want]

    assert write("long", [6, 900, 7]) == [6, 5, 4, 3, 2]
    assert write("short", [2, 0, 1, 900, 7]) == [2, 1, 3, 903, 902]
    assert write("few", [1, 0, 2]) == [1, 3, 2]
