import sys
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import functions as F

from caseloom.operators import segment_review as sr

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
RULE = sr.RuleAnnotator(("cue",))


class Hasty:
    """Quotes in the wrong case at first; where a segment says 'stubborn' it never mends that."""

    def decide(self, segment, previous, feedback):
        at = segment.text.lower().find("cue")
        if at < 0 or previous.label == "Yes":
            return previous
        quote = segment.text[at : at + 3]
        return replace(previous, label="Yes", quote=quote if feedback and "stubborn" not in segment.text else quote.swapcase(), raw_start=segment.raw_start + at)


def fold(rows, annotator):
    out = {}
    for case, place, start, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        out[case] = sr.step(annotator, sr.Segment(case, place, start, text or ""), out.get(case, sr.Decision()))
    return sorted((c, *sr.asdict(d).values()) for c, d in out.items())


ROWS = [("a", 1, 5, "and a cue 😀"), ("a", 0, 0, "first"), ("a", 2, 16, "cue again"), ("b", 0, 0, None), ("c", 0, 0, ""), ("d", 0, 0, "stubborn CUE"), ("d", 1, 12, "Cue"), (None, 0, 0, "cue")]
SEGS = "case_id string, place long, raw_start long, text string"


def test_fold_equals_python_and_asks_once_more(spark):
    df = spark.createDataFrame(ROWS, SEGS)
    for annotator in (RULE, Hasty()):
        assert sorted(map(tuple, sr.review(df, annotator).collect())) == fold(ROWS, annotator)
    got = {r["case_id"]: r for r in sr.review(df, Hasty()).collect()}
    assert (got["a"]["quote"], got["a"]["raw_start"], got["a"]["failed"], got["a"]["reviewed"]) == ("cue", 11, 0, 3)
    assert (got["d"]["quote"], got["d"]["failed"]) == ("Cue", 1) and got["b"]["label"] == "Unsure"
    assert sr.review(df.where("false"), RULE).count() == 0


def test_stream_equals_the_fold(spark, tmp_path):
    for i in range(3):  # a case's segments come in order, over three batches
        spark.createDataFrame([r for r in ROWS if r[1] == i], SEGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(SEGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    q = sr.review_stream(files, Hasty()).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r["case_id"]: tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen.values()) == fold(ROWS, Hasty())


def test_long_text_keeps_offsets(spark):
    text = "x" * 5000 + "cue"
    df = spark.createDataFrame([("k", text)], "id string, t string").withColumn("place", F.lit("clash"))
    r = sr.review(sr.case_segments(df, "id", "t", 300), RULE).first()
    assert text[r["raw_start"] : r["raw_start"] + 3] == "cue" and r["reviewed"] == 36
