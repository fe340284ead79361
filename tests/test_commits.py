import json

import pytest

from caseloom.operators.matcher import find_phrases
from caseloom.streaming import commits, ingest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
CHECKPOINT = "key string, stage string, path string, status string, scanned long"


def state(spark, root, hits):
    got = [commits.read_committed(spark, root, "records", SCHEMA, "doc_id", "last"), commits.read_committed(spark, root, "hits", hits, "hit_id", "first"), commits.read_committed(spark, root, "checkpoints", CHECKPOINT, "key", "last")]
    return [sorted(map(tuple, g.collect()), key=str) for g in got]


@pytest.mark.parametrize("lost", ["hits", "checkpoints", "commit"])
def test_a_crash_between_writes_ends_in_the_batch_result(spark, tmp_path, monkeypatch, lost):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    phrases = spark.createDataFrame([("a", "the"), ("b", "of the")], "query_id string, normalized string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "root")
    write, put = commits.write_chunk, commits.Folder.put
    bad = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    monkeypatch.setattr(commits, "write_chunk", lambda df, r, t: bad() if t == lost and commits.commits(spark, r) else write(df, r, t))
    if lost == "commit":
        monkeypatch.setattr(commits.Folder, "put", lambda self, n, x: bad() if n.endswith("001.json") else put(self, n, x))
    run = lambda: ingest.ingest_catalog(spark, str(tmp_path / "in"), docs.schema, phrases, "doc_id", ["text"], root, str(tmp_path / "cp"), "rev", per_trigger=2)
    with pytest.raises(Exception, match="lost"):
        run()
    assert [c["batch"] for c in commits.commits(spark, root)] == [0]
    half = commits.leftovers(spark, root)
    assert half["orphans"] and not half["partial"]
    hits = find_phrases(docs, phrases, "doc_id", ["text"]).withColumn("hit_id", ingest.F.lit("")).schema
    before = state(spark, root, hits)
    monkeypatch.setattr(commits, "write_chunk", write)
    monkeypatch.setattr(commits.Folder, "put", put)
    run()
    run()  # nothing new
    assert [c["batch"] for c in commits.commits(spark, root)] == [0, 1] and commits.leftovers(spark, root) == {"orphans": [], "partial": []}
    records, found, files = state(spark, root, hits)
    whole = docs.withColumn("path", ingest.F.lit("p"))
    want = ingest.discovered(whole, phrases, "doc_id", ["text"], "rev", "path")
    assert records == sorted(map(tuple, want["records"].select("doc_id", "text").collect()), key=str)
    assert found == sorted(map(tuple, want["hits"].collect()), key=str) and len(before[1]) < len(found)
    assert len(files) == 4 and sum(f[4] for f in files) == docs.count()
    assert commits.progress(spark, root) == {"records": len(records), "hits": len(found), "checkpoints": 4}


def test_chunks_are_named_by_content_and_keys_by_batch(spark, tmp_path):
    root = str(tmp_path / "r")
    df = lambda *rows: spark.createDataFrame(rows, "k int, v string, _batch int")
    first = commits.commit_batch(spark, root, 0, {"t": df((1, "a", 1), (2, "b", None)), "empty": df().where("false")})
    again = commits.write_chunk(df((2, "b", None), (1, "a", 1)).repartition(2), root, "t")
    assert again == first["tables"]["t"] and first["tables"]["empty"]["rows"] == 0
    assert commits.commit_batch(spark, root, 0, {"t": df((9, "never", 1))}) == first
    commits.commit_batch(spark, root, 1, {"t": df((1, "c", 1))})
    read = lambda keep: sorted((r["k"], r["v"]) for r in commits.read_committed(spark, root, "t", "k int, v string, _batch int", "k", keep).collect())
    assert read("last") == [(1, "c"), (2, "b")] and read("first") == [(1, "a"), (2, "b")]
    assert commits.read_committed(spark, root, "none", "k int", "k", "last").count() == 0
    assert json.loads((tmp_path / "r" / "commits" / "000000000001.json").read_text())["batch"] == 1
