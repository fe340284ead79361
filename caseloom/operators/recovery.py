"""Resuming and accounting: plans over shards, compatible checkpoints, cost estimates, budgets, supervision."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.state import resume_key


def compatible(checkpoints: DataFrame, key: Callable[[str], Column], scope: str, new_scope: str) -> DataFrame:
    """Complete, unfiltered, untargeted checkpoints whose key is really that of the old scope: for each path the one that scanned most, under the new scope's key.

    checkpoints: key, path, status, scanned, filtered, targeted.
    """
    ok = checkpoints.where("status = 'complete' AND NOT filtered AND NOT targeted").where(F.col("key") == key(scope))
    return ok.groupBy("path").agg(F.max("scanned").alias("scanned")).select(key(new_scope).alias("key"), "path", "scanned", F.lit("complete").alias("status"))


def scan_plan(shards: DataFrame, done: DataFrame) -> DataFrame:
    """Shards with key, action and reason: complete ones under the same key are reused, all others scanned from the start."""
    d = done.groupBy("key").agg(F.max(F.col("status") == "complete").alias("_complete"))
    j = shards.join(d, "key", "left")
    action = F.when(F.col("_complete"), "reuse").otherwise("scan")
    reason = F.when(F.col("_complete"), "complete_under_same_key").when(F.col("_complete").isNotNull(), "partial_restarts").otherwise("no_checkpoint")
    return j.withColumn("action", action).withColumn("reason", reason).drop("_complete")


# fixed values of the coverage contract
STATES = ("complete", "partial", "failed", "missing", "changed", "duplicated", "source_unavailable", "unverifiable")
MODES = ("incremental", "full", "local_reuse")


def shard_states(inventory: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """path, original_status (of the best checkpoint, null without), current_status (one of STATES), same_as (the path that a duplicate repeats).

    inventory: path, content_identity (null where the source gives none); checkpoints: path, status (complete, partial, failed), scanned, content_identity. Being listed is no success: a shard without
    checkpoint is missing; a checkpoint whose shard is no longer listed is source_unavailable; content seen under a smaller path is duplicated; a checkpoint without identities to compare is unverifiable, with another
    one changed. The best checkpoint is a complete one before a partial before a failed one, then the one that scanned most.
    """
    rank = F.when(F.col("status") == "complete", 2).when(F.col("status") == "partial", 1).otherwise(0)
    best = checkpoints.groupBy("path").agg(F.max(F.struct(rank.alias("rank"), "scanned", "status", F.col("content_identity").alias("was"))).alias("c")).select("path", F.col("c.status").alias("original_status"), "c.was")
    first = inventory.where("content_identity IS NOT NULL").groupBy("content_identity").agg(F.min("path").alias("same_as"))
    rows = inventory.join(first, "content_identity", "left").withColumn("listed", F.lit(True)).join(best, "path", "full")
    twin = F.coalesce(F.col("same_as") != F.col("path"), F.lit(False))
    state = (
        F.when(F.col("listed").isNull(), "source_unavailable").when(twin, "duplicated").when(F.col("original_status").isNull(), "missing")
        .when(F.col("content_identity").isNull() | F.col("was").isNull(), "unverifiable").when(F.col("content_identity") != F.col("was"), "changed").otherwise(F.col("original_status"))
    )
    return rows.select("path", "original_status", state.alias("current_status"), F.when(twin, F.col("same_as")).alias("same_as"))


def mode_plan(states: DataFrame, mode: str) -> DataFrame:
    """states with action and reason. full scans all that can be read; incremental skips what is complete or repeats another shard and scans the rest; local_reuse reads nothing: it reuses what is complete and defers the rest.

    Nothing is skipped without a compatible checkpoint: changed and unverifiable shards are scanned again."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    s = F.col("current_status")
    if mode == "full":
        action = F.when(s == "source_unavailable", "none").otherwise("scan")
        reason = F.when(s == "source_unavailable", s).otherwise("full_scan_requested")
    else:
        rest = "scan" if mode == "incremental" else "defer"
        done = "skip" if mode == "incremental" else "reuse"
        action = F.when(s == "source_unavailable", "none").when(s == "complete", done).when(s == "duplicated", "skip").otherwise(rest)
        reason = F.when(s == "complete", "complete_and_compatible").when(s == "duplicated", F.concat(F.lit("same_content_as:"), "same_as")).when(s == "partial", "partial_restarts").when(s == "missing", "no_checkpoint").otherwise(s)
    return states.withColumns({"action": action, "reason": reason})


def estimate(shards: DataFrame) -> DataFrame:
    """Per kind: rows, seconds, rows a second, and the whole inventory's seconds scaled by bytes, with half and double as bounds.

    shards: kind, bytes, rows, seconds (rows and seconds null where not scanned).
    """
    seen = F.when(F.col("seconds").isNotNull(), F.col("bytes"))
    a = shards.groupBy("kind").agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.sum(seen).alias("seen_bytes"), F.sum("bytes").alias("bytes"))
    whole = F.col("seconds") * F.col("bytes") / F.greatest(F.col("seen_bytes"), F.lit(1))
    return a.select("kind", "rows", F.round("seconds", 6).alias("seconds"), F.round(F.col("rows") / F.greatest("seconds", F.lit(0.001)), 4).alias("rows_per_second"), F.round(whole, 4).alias("estimate"), F.round(whole * 0.5, 4).alias("low"), F.round(whole * 2, 4).alias("high"))


def shard_key(revision: str, path: Column, content: Column, catalog: str, version: str, mode: str) -> Column:
    return resume_key(F.lit(revision), path, F.coalesce(content, F.lit("")), F.lit(catalog), F.lit(version), F.lit(mode))


class BudgetReached(RuntimeError):
    """A budget ended the run; what is complete stays, the rest can be resumed."""


@dataclass
class Budget:
    """Limits looked at between groups of files; None is unlimited."""

    seconds: float | None = None
    bytes: int | None = None
    stop: Callable[[], bool] = lambda: False
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self.began, self.used = self.clock(), 0

    def take(self, size: int) -> None:
        if self.stop():
            raise BudgetReached("stop marker")
        if self.seconds is not None and self.clock() - self.began >= self.seconds:
            raise BudgetReached("time")
        if self.bytes is not None and self.used + size > self.bytes:
            raise BudgetReached("bytes")
        self.used += size


#: what a later attempt may mend: lost files, memory, and any failure of a Spark job that is no mistake in the query itself
TRANSIENT = (OSError, MemoryError, Py4JError, PySparkException)
MISTAKES = (AnalysisException, ParseException, IllegalArgumentException)


def run_groups(groups: list, work: Callable, size: Callable, budget: Budget, passes: int = 2, transient: tuple = TRANSIENT) -> tuple[list, list, str | None]:
    """(done, failed, why it ended early): every group once, failed ones in at most `passes` more rounds; only transient errors are retried."""
    done, todo = [], list(groups)
    for _ in range(1 + passes):
        failed = []
        for i, g in enumerate(todo):
            try:
                budget.take(size(g))
                work(g)
                done.append(g)
            except BudgetReached as e:
                return done, failed + todo[i:], str(e)
            except MISTAKES:
                raise
            except transient:
                failed.append(g)
        if not failed:
            break
        todo = failed
    return done, failed if groups else [], None


def orphans(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path) of stored chunks that no catalog row names; both have path."""
    return stored.select("path").distinct().join(catalog.select("path"), "path", "left_anti")


def unfinished(checkpoints: DataFrame) -> DataFrame:
    """(path) of files that were begun and never completed under any key: they restart from their beginning."""
    best = checkpoints.groupBy("path").agg(F.bool_or(F.col("status") == "complete").alias("done"))
    return best.where("NOT done").select("path")


def integrity(records: DataFrame, hashed: str = "content_hash") -> DataFrame:
    """(typed_id, reason) of records whose content no longer has the hash it was stored with. records: typed_id, json and the hash."""
    now = F.sha2("json", 256)
    reason = F.when(F.col("json").isNull(), "no_content").when(F.col(hashed).isNull(), "no_hash").when(F.col(hashed) != now, "hash_differs")
    return records.select("typed_id", reason.alias("reason")).where("reason IS NOT NULL")


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, expected, actual) of tables whose row counts differ or that only one side has. Both: table_name, n."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), "table_name", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("table_name", "expected", "actual")
