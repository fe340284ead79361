"""Table functions for SQL: SELECT ... FROM t, LATERAL find_phrases(t.text) AS h, and likewise thread_links and text_parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import text_parts
from caseloom.operators.cases import REACH, THREAD_URL
from caseloom.operators.matcher import BLOCK, CONTEXT, Matcher


class TooManyPhrases(ValueError):
    """More phrases than one automaton takes; find_phrases of the DataFrame API goes through them in blocks."""


def register_phrases(spark: SparkSession, phrases: DataFrame, name: str = "find_phrases") -> None:
    """Register name(text): query_id, start, end (source code points), norm_start, quote, context of every match of these phrases (query_id, normalized; BLOCK at most). Null texts have none."""
    pairs = [(str(r["query_id"]), r["normalized"]) for r in phrases.select("query_id", "normalized").limit(BLOCK + 1).collect() if r["normalized"]]
    if len(pairs) > BLOCK:
        raise TooManyPhrases(f"over {BLOCK} phrases")

    @F.udtf(returnType="query_id string, start int, end int, norm_start int, quote string, context string")
    class FindPhrases:
        def __init__(self):
            self.machine = Matcher(pairs)  # once a task

        def eval(self, text: str):
            for q, a, e, n, _ in self.machine.find(text) if text else ():
                yield q, a, e, n, text[a:e], text[max(0, a - CONTEXT) : e + CONTEXT]

    spark.udtf.register(name, FindPhrases)


def register_links(spark: SparkSession, name: str = "thread_links", pattern: str = THREAD_URL) -> None:
    """Register name(text): url, url_start, url_end, thread_id (typed) and quote of every thread URL."""
    found, reach = re.compile(pattern), REACH

    @F.udtf(returnType="url string, url_start int, url_end int, thread_id string, quote string")
    class ThreadLinks:
        def eval(self, text: str):
            for m in found.finditer(text or ""):
                a, e = m.span()
                yield m[0], a, e, "t3_" + next(g for g in m.groups() if g).lower(), text[max(0, a - reach) : e + reach]

    spark.udtf.register(name, ThreadLinks)


def parts_table(rows: DataFrame, text: str, size: int) -> DataFrame:
    """rows with part (from 0) and value of each slice of the text: the table function that Spark's own generators express."""
    return rows.select("*", F.posexplode(text_parts(F.col(text), size)).alias("part", "value"))
