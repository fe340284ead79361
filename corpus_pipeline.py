"""From raw documents to a training mixture: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it back as the next stage's docs. All stages return the columns of documents; the last adds
topic, tokens and the sampling probability. SQL can express neither the classifier nor the raking, so ORACLE_SQL is None and
the tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm._common import materialize, table
from caseloom.llm.decontaminate import decontaminate
from caseloom.llm.mixing import TARGETS, mix
from caseloom.llm.ngram_join import one_of_each
from caseloom.llm.quality import keep_good
from caseloom.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five words and 0.8, the one with the smallest doc_id."""
    return one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; n_chars follows."""
    from pyspark.sql import functions as F

    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target shares."""
    return mix(docs, TARGETS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
