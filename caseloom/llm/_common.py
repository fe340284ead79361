"""Shared plumbing of the training-data operators: table access and shared scratch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.plans.scratch import discard
from caseloom.plans.scratch import new_folder as new_scratch
from caseloom.plans.scratch import written as materialize

__all__ = ["discard", "materialize", "new_scratch", "small_batches", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df: for columns that are added for a while."""
    held, tail = {c.lower() for c in df.columns}, ""
    while any((n + tail).lower() in held for n in names):
        tail += "_"
    return [n + tail for n in names]


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most from now on: rows hold whole texts, and a batch is held by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
