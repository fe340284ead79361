"""Command line: python -m caseloom VERB. Exit code 2 means a budget ended a run that can be resumed."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import normalize_column
from caseloom.operators.matcher import find_phrases
from caseloom.operators.recovery import Budget, run_groups
from caseloom.operators.summaries import hit_id, query_set_hash, retrieval_of
from caseloom.operators.summaries import inventory as inventory_of
from caseloom.plans.scratch import discard, written
from caseloom.plans.versions import Folder
from caseloom.sources import archive, shards, workbook


def inventory(spark, a):
    archive.inventory(spark, a.source, a.revision).write.mode("overwrite").parquet(f"{a.out}/manifest")


def keywords(spark, a):
    p = workbook.phrases(workbook.read_workbooks(spark, a.source)).withColumn("normalized", normalize_column(F.col("phrase")))
    origin = F.struct("path", "sheet", "row", "phrase")
    grouped = p.where("normalized <> ''").groupBy("normalized").agg(F.sort_array(F.collect_list(origin)).alias("origins"))
    grouped.withColumn("query_id", F.concat(F.lit("q_"), F.substring(F.sha2("normalized", 256), 1, 16))).write.mode("overwrite").parquet(f"{a.out}/phrases")


def dry_run(spark, a):
    _selected(spark, a).groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).orderBy("kind").show(truncate=False)


def discover(spark, a):
    """Searches each kind and month once: the folder's checkpoint, put last, holds its key and what was counted while its rows were written.

    The key changes with the revision, the phrases and the folder's files; a folder with another key, or none, is searched again. Nothing is scanned only to be counted."""
    files = _selected(spark, a).select("kind", "month", "path", "bytes").collect()  # the manifest: one row for each shard
    groups: dict[tuple, list] = {}
    for f in files:
        groups.setdefault((f["kind"], f["month"]), []).append(f)
    state, phrases = Folder(spark, a.out), spark.read.parquet(f"{a.out}/phrases")
    searched_for = query_set_hash(phrases).first()[0]
    keys = {g: hashlib.sha256("\n".join([a.revision, searched_for, *g, *sorted(f"{f['path']} {f['bytes']}" for f in groups[g])]).encode()).hexdigest() for g in groups}
    at = lambda g: f"checkpoints/{g[0]}-{g[1]}.json"
    done = lambda g: state.exists(at(g)) and json.loads(state.read(at(g)))["key"] == keys[g]

    def work(g):
        kind, month = g
        raw, seen, kept = archive.read_shards(spark, [f["path"] for f in groups[g]]), Observation(), Observation()
        if state.exists(at(g)):
            state.delete(at(g))
        _, bad = archive.canonical(raw.observe(seen, F.count(F.lit(1)).alias("scanned")), kind, a.site)
        bad.write.mode("overwrite").parquet(f"{a.out}/set_aside/kind={kind}/month={month}")
        good, _ = archive.canonical(raw, kind, a.site)
        hits = find_phrases(good, phrases, "typed_id", ["title", "selftext"] if kind == "submissions" else ["body"])
        hits.observe(kept, F.count(F.lit(1)).alias("hits")).write.mode("overwrite").parquet(f"{a.out}/hits/kind={kind}/month={month}")
        counted = {"scanned": seen.get["scanned"], "hits": kept.get["hits"], "files": len(groups[g]), "bytes": sum(f["bytes"] for f in groups[g])}
        state.put(at(g), json.dumps({"key": keys[g], "stage": "discovery", "kind": kind, "month": month, "status": "complete", **counted}))

    todo = [g for g in groups if not done(g)]
    budget = Budget(a.seconds, a.bytes, lambda: bool(a.stop_file) and os.path.exists(a.stop_file))
    finished, failed, why = run_groups(todo, work, lambda g: sum(f["bytes"] for f in groups[g]), budget)
    print({"done": len(finished), "reused": len(groups) - len(todo), "open": len(failed), "stopped": why})
    return 2 if failed else 0


CHECKPOINT = "key string, stage string, kind string, month string, status string, scanned long, hits long, files long, bytes long"


def progress(spark, out: str):
    """(kind, months, files, bytes, scanned, hits) of what is searched so far, from checkpoints alone: also while a search runs."""
    if not Folder(spark, out).names("checkpoints"):
        return spark.createDataFrame([], "kind string, months long, files long, bytes long, scanned long, hits long")
    done = spark.read.schema(CHECKPOINT).option("pathGlobFilter", "*.json").json(f"{out}/checkpoints")
    return done.groupBy("kind").agg(F.count("*").alias("months"), *(F.sum(c).alias(c) for c in ("files", "bytes", "scanned", "hits")))


def status(spark, a):
    progress(spark, a.out).orderBy("kind").show(truncate=False)


def inspect(spark, a):
    """Columns of all shards in scope and months that one kind alone has, from footers."""
    shards.register(spark)
    footers = written(spark.read.format("shard_footers").options(kinds=",".join(a.kinds or []), start=a.start or "", end=a.end or "").load(a.source), "footers")
    for name, table in (("footers", footers), ("presence", shards.presence(footers)), ("months_of_one_kind", shards.kinds_apart(footers))):
        table.write.mode("overwrite").parquet(f"{a.out}/inspection/{name}")
    discard(footers)


def recover(spark, a):
    """Folders of hits that no checkpoint names: a search broke off there and will write them again. Exit code 2 if there are any."""
    state = Folder(spark, a.out)
    found = {(k[5:], m[6:]) for k in state.names("hits") if k.startswith("kind=") for m in state.names(f"hits/{k}") if m.startswith("month=")}
    broken = sorted(g for g in found if not state.exists(f"checkpoints/{g[0]}-{g[1]}.json"))
    print({"broken": [f"{k} {m}" for k, m in broken]})
    return 2 if broken else 0


def demonstrate_joins(spark, a):
    """Threads that hits name, beside the submissions and comments of the months in scope: which are found there, with how many comments."""
    both = None
    for kind in ("submissions", "comments"):
        paths = [r["path"] for r in _selected(spark, a).where(F.col("kind") == kind).select("path").collect()]
        if paths:
            ids = archive.canonical(archive.read_shards(spark, paths), kind, a.site)[0].select("typed_id", "thread_id", "kind")
            both = ids if both is None else both.unionByName(ids)
    if both is None:
        raise SystemExit("no shard in scope")
    threads = both.join(spark.read.parquet(f"{a.out}/hits").select("typed_id").distinct(), "typed_id", "left_semi").select("thread_id")
    retrieval_of(threads, both).write.mode("overwrite").parquet(f"{a.out}/joins")


def export(spark, a):
    """Hits with their identities as JSON lines and as CSV for spreadsheets."""
    hits = spark.read.parquet(f"{a.out}/hits")
    ident = hit_id(F.col("typed_id"), F.col("query_id"), F.col("field"), F.col("start"), F.col("end"), a.revision)
    hits = hits.withColumn("hit_id", ident).dropDuplicates(["hit_id"])
    hits.write.mode("overwrite").json(f"{a.out}/export/hits_jsonl")
    archive.write_csv(hits, f"{a.out}/export/hits_csv")


def report(spark, a):
    """Coverage as Markdown: shards, bytes, searched months, hits and records of each kind."""
    files = _selected(spark, a)
    hits = spark.read.parquet(f"{a.out}/hits").groupBy("kind").agg(F.count("*").alias("hits"), F.countDistinct("typed_id").alias("records"), F.countDistinct("month").alias("searched"))
    rows = inventory_of(files).join(hits, "kind", "left").orderBy("kind").collect()  # a row for each kind
    head = ["kind", "shards", "bytes", "first_month", "last_month", "months", "searched", "hits", "records"]
    lines = ["# Coverage", "", f"| {' | '.join(head)} |", "|" + " --- |" * len(head), *[f"| {' | '.join('' if r[c] is None else str(r[c]) for c in head)} |" for r in rows]]
    lines += ["", "Months without hits and months not searched are not told apart here. Candidates are not confirmed cases."]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")


def _selected(spark, a):
    return archive.select_files(spark.read.parquet(f"{a.out}/manifest"), a.kinds, a.start, a.end)


VERBS = {"inventory": inventory, "import-keywords": keywords, "dry-run": dry_run, "discover": discover, "status": status, "inspect": inspect, "recover": recover, "demonstrate-joins": demonstrate_joins, "export": export, "report": report}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="caseloom")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--source", help="folder of shards or workbooks")
    p.add_argument("--out", required=True, help="shared output folder")
    p.add_argument("--revision", default="")
    p.add_argument("--site", default="", help="address in front of permalinks")
    p.add_argument("--kinds", nargs="*")
    p.add_argument("--start", help="first month, YYYY-MM")
    p.add_argument("--end", help="last month, YYYY-MM")
    p.add_argument("--seconds", type=float)
    p.add_argument("--bytes", type=int)
    p.add_argument("--stop-file")
    a = p.parse_args(argv)
    return VERBS[a.verb](SparkSession.builder.appName("caseloom").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
