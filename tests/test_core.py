import re
import sys
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloom import queries as q
from caseloom.functions.text import normalize, normalized_offsets
from caseloom.operators.matcher import Matcher, find_phrases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in q.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    return sorted((tuple(r) for r in df), key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = q.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    mine = rows(got.select(*names).collect())
    if name not in q.ORACLE:
        assert mine
        return
    want = duck.sql(q.ORACLE[name])
    assert sorted(want.columns) == names
    assert mine == rows(duck.sql(f"SELECT {', '.join(names)} FROM ({q.ORACLE[name]})").fetchall())


@pytest.mark.parametrize("text", ["Straße ﬁn x", "각 각", "ẹ́ ạ́", "Ａｂ　Ｃ", "😀 RECOGNISED\t my\npost", "", " \n ", "ཱཱིི", "কো", "İ"])
def test_offsets_follow_normalisation(text):
    norm, begin, end = normalized_offsets(text)
    assert norm == normalize(text) and len(norm) == len(begin) == len(end)
    assert all(0 <= a < b <= len(text) for a, b in zip(begin, end, strict=True))


def test_offsets_of_all_decomposable_characters():
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            for t in (c, f"a{c}b", unicodedata.normalize("NFD", c)):
                assert normalized_offsets(t)[0] == normalize(t)


def test_matches_keep_source_offsets_and_word_edges():
    m = Matcher([("a", "recognized my post"), ("b", "my post")])
    text = "😀 I RECOGNISED\t my\npost!"
    hits = {h[0]: text[h[1] : h[2]] for h in m.find(text)}
    assert hits == {"a": "RECOGNISED\t my\npost", "b": "my\npost"}
    assert m.find("recognized my poster") == [] and Matcher([]).find("x") == []


def test_prefilter_loses_nothing(spark):
    docs = spark.createDataFrame([(1, "I was RECOGNISED here"), (2, "ｒｅｃｏｇｎｉｚｅｄ"), (3, None), (4, ""), (5, "recognizedx"), (6, "ﬁnd recognized")], "k long, t string")
    phrases = spark.createDataFrame([("p", "recognized")], "query_id string, normalized string")
    on, off = (find_phrases(docs, phrases, "k", ["t"], prefilter=p) for p in (True, False))
    assert rows(on.collect()) == rows(off.collect())
    assert sorted(r["k"] for r in on.collect()) == [1, 2, 6]


def test_streamed_files_give_the_batch_result(spark, tmp_path):
    from caseloom.streaming.ingest import ingest

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    phrases = spark.createDataFrame([("a", "the"), ("b", "of the")], "query_id string, normalized string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), docs.schema, phrases, "doc_id", ["text"], str(tmp_path / "out"), str(tmp_path / "cp"))
    want = find_phrases(docs, phrases, "doc_id", ["text"])
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()) == rows(want.collect())
