import json

import pytest
from pyspark.sql import functions as F

from caseloom.__main__ import main, progress
from caseloom.sources import archive, workbook


@pytest.fixture
def places(spark, tmp_path):
    """Two months of comments, one of submissions; two phrases."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    for kind, col, months in (("submissions", "selftext", ("01",)), ("comments", "body", ("01", "02"))):
        for m in months:
            rows = [("1" + m, "t3_101", "I lost my post"), ("2" + m, "t3_999", "my post, my post"), ("3" + m, None if kind == "comments" else "t3_1", "none")]
            spark.createDataFrame(rows, f"id string, link_id string, {col} string").coalesce(1).write.parquet(str(src / "data" / kind / "2010" / m))
    (tmp_path / "k.xlsx").write_bytes(workbook.workbook_bytes({"S": (["Search Phrase"], [["my post"]])}))
    assert main(["inventory", "--source", str(src), "--out", out]) == 0 and main(["import-keywords", "--source", str(tmp_path / "k.xlsx"), "--out", out]) == 0
    return str(src), out


def test_counts_come_with_the_writes(spark, places, tmp_path):
    _, out = places
    assert progress(spark, out).count() == 0
    assert main(["discover", "--out", out, "--kinds", "comments"]) == 0
    got = {r["kind"]: r for r in progress(spark, out).collect()}
    assert set(got) == {"comments"} and (got["comments"]["months"], got["comments"]["scanned"], got["comments"]["hits"]) == (2, 6, 6)
    assert main(["discover", "--out", out]) == 0 and main(["status", "--out", out]) == 0
    got = {r["kind"]: r for r in progress(spark, out).collect()}
    assert got["comments"]["hits"] + got["submissions"]["hits"] == spark.read.parquet(f"{out}/hits").count() == 9
    assert spark.read.parquet(f"{out}/set_aside").count() == 2  # comments without a thread


def test_a_search_is_resumed_by_its_key(spark, places, tmp_path, capsys):
    _, out = places
    said = lambda: capsys.readouterr().out.strip().splitlines()[-1]
    main(["discover", "--out", out])
    assert "'done': 3, 'reused': 0" in said()
    main(["discover", "--out", out])
    assert "'done': 0, 'reused': 3" in said()
    (tmp_path / "out" / "checkpoints" / "comments-2010-02.json").unlink()
    assert main(["recover", "--out", out]) == 2 and "comments 2010-02" in said()
    main(["discover", "--out", out])
    assert "'done': 1, 'reused': 2" in said() and main(["recover", "--out", out]) == 0
    main(["discover", "--out", out, "--revision", "other"])
    capsys.readouterr()
    main(["discover", "--out", out])  # the folder now holds another revision's hits
    assert "'done': 3, 'reused': 0" in said()
    assert len(json.loads((tmp_path / "out" / "checkpoints" / "comments-2010-01.json").read_text())["key"]) == 64


def test_inspection_and_joins(spark, places):
    src, out = places
    assert main(["inspect", "--source", src, "--out", out]) == 0
    p = {(r["kind"], r["column"]): r["absent"] for r in spark.read.parquet(f"{out}/inspection/presence").collect()}
    assert p[("comments", "body")] == 0 and ("comments", "selftext") not in p and spark.read.parquet(f"{out}/inspection/footers").agg(F.sum("rows")).first()[0] == 9
    assert [tuple(r) for r in spark.read.parquet(f"{out}/inspection/months_of_one_kind").collect()] == [("2010-02", "comments")]
    main(["discover", "--out", out])
    assert main(["demonstrate-joins", "--out", out, "--start", "2010-01", "--end", "2010-01"]) == 0
    got = sorted(map(tuple, spark.read.parquet(f"{out}/joins").collect()))
    assert got == [("t3_101", True, 1), ("t3_201", True, 0), ("t3_999", False, 1)]
    with pytest.raises(SystemExit):
        main(["demonstrate-joins", "--out", out, "--start", "2011-01"])


def test_records_without_rows(spark, tmp_path):
    good, bad = archive.canonical(spark.createDataFrame([], archive.RECORD), "comments", "")
    assert good.count() == bad.count() == 0
