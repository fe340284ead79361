"""Incremental ingestion: new files once each, matches appended, the same rows as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.matcher import find_phrases
from caseloom.operators.state import resume_key
from caseloom.operators.summaries import hit_id
from caseloom.plans.scratch import discard, unused, written
from caseloom.streaming.commits import commit_batch


def ingest(spark: SparkSession, source: str, schema, phrases: DataFrame, key: str, fields: list[str], out: str, checkpoint: str) -> None:
    """Take in all files of source not taken in before; a batch that is run again overwrites its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        find_phrases(df, phrases, key, fields).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def discovered(df: DataFrame, phrases: DataFrame, key: str, fields: list[str], revision: str, path: str) -> dict[str, DataFrame]:
    """records that match, their hits and a checkpoint for each file, of rows with the file's path in the column `path`.

    Checkpoints: key, stage, path, status, scanned. The key changes with the revision, the file and the set of phrases."""
    queries = phrases.agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "query_id", "normalized"))), "\n"), 256)).first()[0]  # phrases, not texts: they fit an automaton
    hits = find_phrases(df, phrases, key, fields)
    hits = written(hits.withColumn("hit_id", hit_id(F.col(key).cast("string"), F.col("query_id"), F.col("field"), F.col("start").cast("string"), F.col("end").cast("string"), revision)), "hits")
    files = df.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("scanned"))
    checkpoints = files.select(resume_key(F.lit(revision), F.col("path"), F.lit("discovery"), F.lit(queries)).alias("key"), F.lit("discovery").alias("stage"), "path", F.lit("complete").alias("status"), "scanned")
    return {"records": df.join(hits.select(key).distinct(), key, "left_semi").drop(path), "hits": hits, "checkpoints": checkpoints}


def ingest_catalog(spark: SparkSession, source: str, schema, phrases: DataFrame, key: str, fields: list[str], root: str, checkpoint: str, revision: str, per_trigger: int = 64) -> None:
    """Take in new files of source: records, hits and checkpoints of a batch are committed together, once, whatever is interrupted and run again."""

    def write(df: DataFrame, batch_id: int) -> None:
        tables = discovered(df, phrases, key, fields, revision, path)
        commit_batch(spark, root, batch_id, tables)
        discard(tables["hits"])

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    (path,) = unused(rows, "_path")
    rows = rows.select("*", F.col("_metadata.file_path").alias(path))
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
