"""Keyed state as Parquet buckets with versions: only buckets with changed keys are rewritten, readers see whole versions.

Layout under root: data/bucket=B/version=V/*.parquet and manifests/V.json, which names the version of every bucket. A version
exists once its manifest does; what an interrupted merge leaves behind belongs to no manifest and is overwritten by the next one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.scratch import discard, unused, written


class Folder:
    """Small files in any store that Spark can open."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root, self.spark = root.rstrip("/"), spark
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        p = self.at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write beside, then rename: the file is there whole or not at all. One that is there already stays, and is an error."""
        self.fs.mkdirs(self.at(name).getParent())
        new = self.at(f"{name}.new")
        out = self.fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(new, self.at(name)):
            raise FileExistsError(f"{self.root}/{name}")

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise FileExistsError(f"{self.root}/{target}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifest(folder: Folder) -> dict:
    found = [n for n in folder.names("manifests") if n.endswith(".json")]
    return json.loads(folder.read(f"manifests/{found[-1]}")) if found else {"version": 0, "buckets": {}, "count": 64}


def read_state(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of a given one; empty before the first."""
    folder = Folder(spark, root)
    m = _manifest(folder) if version is None else json.loads(folder.read(f"manifests/{version:09d}.json"))
    paths = [f"{folder.root}/data/bucket={b}/version={v}" for b, v in m["buckets"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_changed(rows: DataFrame, key: str, content_hash: str, root: str, buckets: int = 64) -> dict[str, int]:
    """Bring the state under root to `rows` (any number for each key, all with the key's content_hash); returns the counts of keys added, changed, removed, unchanged and of buckets written.

    Keys and hashes are compared first, reading no other column of the state. Nothing is written where no key differs. The number of
    buckets holds for the life of the state; the driver sees bucket numbers only. One merge at a time: of two, the later fails at its manifest. Rows without a key take no part.
    """
    spark = rows.sparkSession
    folder = Folder(spark, root)
    m = _manifest(folder)
    n = m["count"] if m["version"] else buckets
    at, was, now = unused(rows, "_bucket", "_was", "_now")
    rows = rows.where(F.col(key).isNotNull()).withColumn(at, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int"))
    new = rows.groupBy(key, at).agg(F.min(content_hash).alias(now))
    old = read_state(spark, root, rows.drop(at).schema).groupBy(key).agg(F.min(content_hash).alias(was)).withColumn(at, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int"))
    kind = F.when(F.col(was).isNull(), "added").when(F.col(now).isNull(), "removed").when(F.col(was) != F.col(now), "changed").otherwise("unchanged")
    diff = written(new.join(old, [key, at], "full").select(at, kind.alias("kind")).groupBy(at, "kind").count(), "diff")
    counts = {"added": 0, "changed": 0, "removed": 0, "unchanged": 0} | {r["kind"]: r["n"] for r in diff.groupBy("kind").agg(F.sum("count").alias("n")).collect()}
    touched = sorted(r[at] for r in diff.where("kind <> 'unchanged'").select(at).distinct().collect())
    discard(diff)
    if touched:
        version = m["version"] + 1
        # dealt by bucket and a slice of the key, so that a large bucket is several files
        part = rows.where(F.col(at).isin(touched)).withColumns({"bucket": F.col(at), "version": F.lit(version)}).drop(at).repartition("bucket", F.pmod(F.xxhash64(F.lit(1), key), F.lit(4)))
        for b in touched:  # of a merge that was interrupted
            folder.delete(f"data/bucket={b}/version={version}")
        part.write.mode("append").partitionBy("bucket", "version").parquet(f"{folder.root}/data")
        held = {b: v for b, v in m["buckets"].items() if int(b) not in touched} | {str(b): version for b in touched if folder.exists(f"data/bucket={b}/version={version}")}
        folder.put(f"manifests/{version:09d}.json", json.dumps({"version": version, "count": n, "buckets": held}))
    return counts | {"buckets_written": len(touched)}
