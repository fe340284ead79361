"""Manifests of input files as hash trees: what changed is found without rereading all, and reads stay on what a manifest names.

A leaf is a file: path (relative to the root), folder, bytes, modified, digest (SHA-256 of its content). A node is a folder: the digest of all leaves below it, whatever their order. Files are listed, hashed and
summed by Spark; a file is hashed by one task in its JVM, so it must fit an array (2 GiB), as shards of an archive do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.scratch import written

#: up to so many new files are opened by their names; beyond, a scan of the whole root is joined
NAMED = 100_000
LEAF = "path string, folder string, bytes long, modified timestamp, digest string"


class Changed(RuntimeError):
    """Files that a manifest names are gone or other than it says."""


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    return files.select(rel.alias("rel"), F.regexp_replace(rel, r"/?[^/]*$", "").alias("folder"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def file_digests(spark: SparkSession, root: str, pattern: str = "*.parquet", known: DataFrame | None = None) -> DataFrame:
    """Leaves of all files under root. known: an earlier manifest's leaves; files of the same path, size and time keep their digest and are not read."""
    listed = _listed(spark, root, pattern)
    if known is None:
        return listed.select(F.col("rel").alias("path"), "folder", "bytes", "modified", F.sha2("content", 256).alias("digest"))
    same = known.select(F.col("path").alias("rel"), "bytes", "modified", "digest")
    listing = written(listed.drop("content").join(same, ["rel", "bytes", "modified"], "left"), "listing")
    leaf = [F.col("rel").alias("path"), "folder", "bytes", "modified"]
    kept = listing.where("digest IS NOT NULL").select(*leaf, "digest")
    new = [r["rel"] for r in listing.where("digest IS NULL").select("rel").limit(NAMED + 1).collect()]
    if not new:
        return kept
    if len(new) <= NAMED:  # a scan of these files alone
        files = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in new]).select(_listed_name(root).alias("rel"), "content")
    else:
        files = listed.select("rel", "content")
    return kept.unionByName(listing.where("digest IS NULL").drop("digest").join(files, "rel").select(*leaf, F.sha2("content", 256).alias("digest")))


def _listed_name(root: str) -> Column:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.substring(F.regexp_replace("path", r"^[a-z]+:/*", ""), F.lit(len(base) + 2), F.lit(1 << 20))


def tree(leaves: DataFrame) -> DataFrame:
    """(folder, files, bytes, digest) of every folder, '' for the root: sums of leaf digests, combined before the shuffle."""
    up = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(up))), lambda i: F.array_join(F.slice(up, F.lit(1), i), "/"))
    own = F.sha2(F.concat_ws("\x1f", "path", F.col("bytes").cast("string"), "digest"), 256)
    sums = [F.sum(F.conv(F.substring("own", i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 13, 25, 37)]
    each = leaves.select(F.explode(F.array_distinct(above)).alias("folder"), "bytes", own.alias("own"))
    got = each.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *sums)
    return got.select("folder", "files", "bytes", F.sha2(F.concat_ws(":", "files", "s1", "s13", "s25", "s37"), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests: added, removed or changed. Only folders whose digests differ are looked into, and nothing where the roots agree."""
    a, b = tree(old).select("folder", F.col("digest").alias("a")), tree(new).select("folder", F.col("digest").alias("b"))
    odd = a.join(b, "folder", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("folder")
    left = old.join(odd, "folder", "left_semi").select("path", F.col("digest").alias("a"))
    right = new.join(odd, "folder", "left_semi").select("path", F.col("digest").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return left.join(right, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


def artifact(run_id: str, method: str, scope: str, inputs: DataFrame, outputs: dict[str, DataFrame], limitations: list[str]) -> DataFrame:
    """The manifest row of a run: run_id, method, scope, inputs (files, bytes, root digest), outputs (name and rows), limitations. Counts are of written tables."""
    spark = inputs.sparkSession
    root = tree(inputs).where("folder = ''").select(F.struct("files", "bytes", "digest").alias("inputs"))
    made = [(n, t.count()) for n, t in outputs.items()]
    about = F.lit(None).cast("array<struct<name:string,rows:bigint>>") if not made else F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).cast("long").alias("rows")) for n, c in made])
    empty = spark.range(1).select(F.struct(F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("0"), 256).alias("digest")).alias("none"))
    return empty.join(root, F.lit(True), "left").select(
        F.lit(run_id).alias("run_id"), F.lit(method).alias("method"), F.lit(scope).alias("scope"), F.coalesce("inputs", "none").alias("inputs"), about.alias("outputs"), F.array(*[F.lit(x) for x in limitations]).cast("array<string>").alias("limitations")
    )


def read_pinned(spark: SparkSession, root: str, leaves: DataFrame, schema, verify: bool = False) -> DataFrame:
    """The rows of exactly the files that the manifest names. Files that are gone or have another size or time raise Changed; with verify their contents are hashed again first."""
    now = file_digests(spark, root, "*", None if verify else leaves) if verify else _listed(spark, root, "*").select(F.col("rel").alias("path"), "bytes", "modified")
    on = ["path", "bytes", "digest"] if verify else ["path", "bytes", "modified"]
    bad = leaves.join(now.select(*on), on, "left_anti").select("path").limit(20).collect()
    if bad:
        raise Changed(", ".join(sorted(r["path"] for r in bad)))
    paths = [f"{root.rstrip('/')}/{r['path']}" for r in leaves.select("path").collect()]  # names of files, as any scan's plan holds them
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
