"""Batches of several tables that are committed together, once each.

Layout under root: chunks/<table>/<digest>, named by the content of its rows whatever their order; pending/, while a chunk is written; and commits/<batch>.json, written last,
which names the chunk and the rows of each table. Readers see the chunks of commits only. A batch that comes again after a crash finds its chunks by their names and
its commit by its number, so nothing is doubled. Rows are counted and hashed while they are written; a chunk that then holds another number of rows is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.state import upsert
from caseloom.plans.scratch import unused
from caseloom.plans.versions import Folder

PIECES = (1, 13, 25, 37)


class LostRows(RuntimeError):
    """A chunk holds another number of rows than were written to it."""


def _digest(seen: dict) -> str:
    import hashlib

    return hashlib.sha256(":".join(str(seen[k] or 0) for k in ("rows", *(f"s{i}" for i in PIECES))).encode()).hexdigest()


def write_chunk(df: DataFrame, root: str, table: str) -> dict:
    """Write df as a chunk of the table unless it is there: {chunk, rows}. One pass: count and content hash are observed in the write itself."""
    folder, seen, part = Folder(df.sparkSession, root), Observation(), f"pending/{table}-{uuid.uuid4().hex}"
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in PIECES]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).write.option("compression", "zstd").parquet(f"{folder.root}/{part}")
    got = seen.get
    name = _digest(got)
    if folder.exists(f"chunks/{table}/{name}"):
        folder.delete(part)
    else:
        held = df.sparkSession.read.schema(df.schema).parquet(f"{folder.root}/{part}").count()  # of the footers
        if held != got["rows"]:
            raise LostRows(f"{part}: {held} rows of {got['rows']}")
        folder.move(part, f"chunks/{table}/{name}")
    return {"chunk": name, "rows": got["rows"]}


def commit_batch(spark: SparkSession, root: str, batch_id: int, tables: dict[str, DataFrame]) -> dict:
    """Write all tables, then the commit; a batch that is committed already is left alone. Returns the commit."""
    folder, name = Folder(spark, root), f"commits/{batch_id:012d}.json"
    if not folder.exists(name):
        done = {t: write_chunk(df, root, t) for t, df in tables.items()}
        folder.put(name, json.dumps({"batch": batch_id, "tables": done}))
    return json.loads(folder.read(name))


def commits(spark: SparkSession, root: str) -> list[dict]:
    """All commits in order: a few numbers for each batch."""
    folder = Folder(spark, root)
    return [json.loads(folder.read(f"commits/{n}")) for n in folder.names("commits") if n.endswith(".json")]


def progress(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows committed to each table so far, from the commits alone: no table is read."""
    out: dict[str, int] = {}
    for c in commits(spark, root):
        for t, x in c["tables"].items():
            out[t] = out.get(t, 0) + x["rows"]
    return out


def read_committed(spark: SparkSession, root: str, table: str, schema, key: str, keep: str) -> DataFrame:
    """The table as committed: of the rows of one key the last batch's ('last') or the first batch's ('first') counts."""
    held: dict[str, list[int]] = {}
    for c in commits(spark, root):
        if table in c["tables"]:
            held.setdefault(c["tables"][table]["chunk"], []).append(c["batch"])
    if not held:
        return spark.createDataFrame([], schema)
    which = max if keep == "last" else min
    rows = spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/chunks/{table}/{c}" for c in held])
    chunk, seq = unused(rows, "_chunk", "_batch")
    rows = rows.withColumn(chunk, F.regexp_extract(F.col("_metadata.file_path"), rf"chunks/{table}/([0-9a-f]+)/", 1))
    order = spark.createDataFrame([(c, which(b)) for c, b in held.items()], f"{chunk} string, {seq} long")  # a row for each commit
    return upsert(rows.join(F.broadcast(order), chunk).drop(chunk), key, seq, keep).drop(seq)


def leftovers(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """What a crash left: chunks that no commit names (whole, and found again when their batch comes again) and half-written ones."""
    folder = Folder(spark, root)
    named = {f"{t}/{x['chunk']}" for c in commits(spark, root) for t, x in c["tables"].items()}
    whole = [f"{t}/{c}" for t in folder.names("chunks") for c in folder.names(f"chunks/{t}") if f"{t}/{c}" not in named]
    return {"orphans": whole, "partial": folder.names("pending")}
