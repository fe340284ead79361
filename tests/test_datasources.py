import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from caseloom.sources import shards, sheets, workbook


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Comments of three months, the first without score; submissions of two, one of them with score as a double."""
    root = str(tmp_path_factory.mktemp("archive"))
    shards.register(spark)
    rows = spark.range(600).select(F.concat(F.lit("2020-0"), (F.col("id") % 3 + 1)).alias("month"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("body "), "id")).alias("body"), F.col("id").cast("int").alias("score"))
    shards.write_shards(rows.where("month > '2020-01'").withColumn("kind", F.lit("comments")), root)
    shards.write_shards(rows.where("month = '2020-01'").drop("score").withColumn("kind", F.lit("comments")), root)
    shards.write_shards(rows.where("month = '2020-02'").drop("body").withColumn("kind", F.lit("submissions")), root)
    shards.write_shards(rows.where("month = '2020-03'").drop("body").withColumn("score", F.col("score") + 0.5).withColumn("kind", F.lit("submissions")), root)
    return root


def test_records_are_read_with_the_columns_of_all_shards(spark, archive):
    df = spark.read.format("shards").load(archive)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("kind", "string"), ("month", "string"), ("source_path", "string"), ("body", "string"), ("id", "string"), ("score", "double")]
    got = {(r["kind"], r["month"]): tuple(r)[2:] for r in df.groupBy("kind", "month").agg(F.count("*"), F.count("body"), F.count("score"), F.sum("score")).collect()}
    ids = {m: [i for i in range(600) if i % 3 + 1 == m] for m in (1, 2, 3)}
    full = {m: sum(i % 4 > 0 for i in ids[m]) for m in ids}
    assert got == {
        ("comments", "2020-01"): (200, full[1], 0, None), ("comments", "2020-02"): (200, full[2], 200, sum(ids[2])), ("comments", "2020-03"): (200, full[3], 200, sum(ids[3])),
        ("submissions", "2020-02"): (200, 0, 200, sum(ids[2])), ("submissions", "2020-03"): (200, 0, 200, sum(ids[3]) + 100),
    }


def _opened(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_options_decide_which_shards_are_opened(spark, archive):
    read = lambda **o: spark.read.format("shards").options(**o).load(archive)
    whole, one = read(), read(kinds="comments", start="2020-02", end="2020-02")
    assert _opened(whole) == len(shards.listed(archive)) > _opened(one) == len(shards.listed(archive, shards.Scope(("comments",), "2020-02", "2020-02")))
    assert one.count() == 200 and read(start="2020-03").count() == 400 and read(end="2020-01").count() == 200 and spark.read.format("shard_footers").option("kinds", "submissions").load(archive).agg(F.sum("rows")).first()[0] == 400
    a, b = whole.where("month = '2020-01'"), whole.where("month = '2020-03'")  # of one load: neither takes rows from the other
    assert a.count() == 200 and b.count() == 400 and whole.count() == 1000 and a.unionByName(b).count() == 600
    with pytest.raises(Exception, match="give a schema"):
        read(kinds="other")


def test_pieces_of_a_shard_hold_each_row_once(spark, archive):
    cut = spark.read.format("shards").option("split_bytes", 700).schema("id string, kind string").load(archive).where("kind = 'submissions'")
    assert _opened(cut) >= 2 and cut.count() == 400 and cut.distinct().count() == 400
    assert spark.read.format("shards").schema("kind string").load(archive).groupBy("kind").count().where("count in (400, 600)").count() == 2


def test_presence_and_months_of_one_kind(spark, archive):
    foot = spark.read.format("shard_footers").option("files_per_task", 2).load(archive)
    assert foot.agg(F.sum("rows")).first()[0] == 1000 and foot.where("month = '2020-01'").select("kind").distinct().count() == 1
    p = {(r["kind"], r["column"]): r for r in shards.presence(foot).collect()}
    early = len([s for s in shards.listed(archive) if (s.kind, s.month) == ("comments", "2020-01")])
    assert p[("comments", "score")]["absent"] == early and p[("comments", "score")]["first_month"] == "2020-02" and ("submissions", "body") not in p
    assert p[("submissions", "score")]["types"] == ["double", "int"] and p[("comments", "id")]["absent"] == 0
    assert [tuple(r) for r in shards.kinds_apart(foot).collect()] == [("2020-01", "comments")]


def test_folders_without_shards(spark, tmp_path):
    shards.register(spark)
    assert spark.read.format("shard_footers").load(str(tmp_path)).count() == 0 and spark.read.format("shards").schema("id string").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="give a schema"):
        spark.read.format("shards").load(str(tmp_path))
    with pytest.raises(Exception, match="has no shard"):
        shards.write_shards(spark.createDataFrame([("comments", None, 1)], "kind string, month string, id int"), str(tmp_path))
    assert not (tmp_path / "data").exists()


def test_sheets_are_tasks_and_chosen_by_name(spark, tmp_path):
    sheets.register(spark)
    for i in range(2):
        (tmp_path / f"w{i}.xlsx").write_bytes(workbook.workbook_bytes({f"S{j}": (["Search Phrase"], [[f"p{i}{j}"], ["=x"]]) for j in range(3)}))
    df = spark.read.format("workbook_sheets").load(str(tmp_path))
    assert _opened(df) == 6 and _opened(only := spark.read.format("workbook_sheets").option("sheets", '["S1"]').load(str(tmp_path))) == 2
    assert sorted(r["phrase"] for r in workbook.phrases(only).collect()) == ["=x", "=x", "p01", "p11"]
    old = workbook.read_workbooks(spark, str(tmp_path)).select("sheet", "row", "cells")
    assert sorted(map(str, old.collect())) == sorted(map(str, df.select("sheet", "row", "cells").collect()))


def test_written_workbooks_read_back(spark, tmp_path):
    sheets.register(spark)
    day = dt.datetime(2024, 2, 29, 12)
    rows = [(i, f"=a & <b> {i} 😀", None if i % 2 else 0.5, day if i == 0 else None, ["x", None], True, None, float("nan") if i == 1 else 2.0) for i in range(25)]
    df = spark.createDataFrame(rows, "`id` int, `title` string, half double, at timestamp, tags array<string>, ok boolean, `Reviewer label` string, odd double").repartition(3)
    out = str(tmp_path / "out")
    df.write.format("workbook").option("rows_per_part", 4).option("sheet", "R & D").option("choices", json.dumps({"Reviewer label": ["Yes", "No"]})).mode("append").save(out)
    df.where("id = 3").write.format("workbook").mode("append").save(out)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == [f"part-{i:05d}.xlsx" for i in range(len(files))] and len(files) > 7
    got = spark.read.format("workbook_sheets").load(out).where("row > 1 AND sheet = 'R & D'").collect()
    assert max(r["row"] for r in got) == 5 and sorted(int(r["cells"]["A"]) for r in got) == list(range(25))
    first = next(r["cells"] for r in got if r["cells"]["A"] == "0")
    assert first["B"] == "=a & <b> 0 😀" and first["C"] == "0.5" and float(first["D"]) == 45351.5 and first["E"] == '["x", null]' and first["F"] == "1" and next(r["cells"]["H"] for r in got if r["cells"]["A"] == "1") == "nan"
    with zipfile.ZipFile(f"{out}/part-00000.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert '<formula1>"Yes,No"</formula1>' in sheet and 'xSplit="1"' in sheet and 'ref="A1:H5"' in z.read("xl/tables/table1.xml").decode()


def test_workbooks_without_rows_and_texts_that_fit_no_cell(spark, tmp_path):
    sheets.register(spark)
    empty, long = str(tmp_path / "e"), str(tmp_path / "l")
    spark.createDataFrame([], "a int, b string").write.format("workbook").mode("append").save(empty)
    assert [(r["row"], r["cells"]) for r in spark.read.format("workbook_sheets").load(empty).collect()] == [(1, {"A": "a", "B": "b"})]
    with pytest.raises(Exception, match="fits no cell"):
        spark.createDataFrame([("x" * 32768,)], "b string").write.format("workbook").mode("append").save(long)
    assert list((tmp_path / "l").iterdir()) == []
    odd = ["x" * 32767, "", None, "a\r\nb\x00\x0c\uffff", "_x000D_ _x00_ __x0041_", " \t "]
    spark.createDataFrame([(v,) for v in odd], "b string").coalesce(1).write.format("workbook").mode("append").save(long)
    assert [r["cells"].get("A") for r in spark.read.format("workbook_sheets").load(long).where("row > 1").orderBy("row").collect()] == odd
    with pytest.raises(Exception, match="different names"):
        spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "A").write.format("workbook").mode("append").save(long)
