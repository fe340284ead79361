"""Which records, files, targets and rows go on: filters, lookups, set operations, ranks and orders.

Nulls never match a key. Ties are broken by the id, so every result is the same at any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.matcher import any_of


def bare_id(c: Column) -> Column:
    """An id without its t1_/t3_ prefix."""
    return F.regexp_replace(c, "^t[13]_", "")


def of_targets(records: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Records whose key, prefix or not, is one of the targets (first column)."""
    wanted = targets.select(bare_id(F.col(targets.columns[0]).cast("string")).alias("_bare")).distinct()
    return records.withColumn("_bare", bare_id(F.col(key).cast("string"))).join(wanted, "_bare", "left_semi").drop("_bare")


def in_any_case(c: Column, values: list[str]) -> Column:
    """Whether c is one of the values, whatever the case; no values, no restriction."""
    return F.lower(c).isin([v.lower() for v in values]) if values else F.lit(True)


def holds_a_word(fields: list[str], words: list[str]) -> Column:
    """Whether some field holds one of the (lower-case) words; a null field holds none."""
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(F.col(f), F.lit("")).rlike(f"(?i){any_of(words)}")
    return test


def complete_targets(files: DataFrame, members: DataFrame) -> DataFrame:
    """(seed_key, files): how many complete context files hold all threads of a case among their targets.

    files: path, status, target (a row for each); members: seed_key, thread. A case no file covers has 0."""
    size = members.groupBy("seed_key").agg(F.countDistinct("thread").alias("_size"))
    held = members.select("seed_key", F.col("thread").alias("target")).distinct().join(files.where("status = 'complete'").select("path", "target").distinct(), "target")
    whole = held.groupBy("seed_key", "path").agg(F.count("*").alias("_held")).join(size, "seed_key").where("_held = _size")
    return size.join(whole.groupBy("seed_key").agg(F.count("*").alias("files")), "seed_key", "left").select("seed_key", F.coalesce("files", F.lit(0).cast("long")).alias("files"))


def month_of(seconds: Column) -> Column:
    """UTC month of epoch seconds; unknown times count as the epoch."""
    return F.date_format(F.timestamp_seconds(F.coalesce(seconds, F.lit(0))), "yyyy-MM")


def until_month(seeds: DataFrame, seconds: str, last: str) -> DataFrame:
    return seeds.where(month_of(F.col(seconds)) <= last)


def not_collected(matches: DataFrame, prior: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Matches of records that were not collected before, and the count of those that were."""
    known = prior.select(key).distinct()
    return matches.join(known, key, "left_anti"), matches.join(known, key, "left_semi").agg(F.count("*").alias("known_matches"))


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Distinct wanted keys that are not held."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(held.select(key), key, "left_anti")


def unresolved_targets(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """(target_thread) of supported links to posts that were not collected."""
    return missing(edges.where("supported").select(F.col("target_thread").alias("typed_id")), posts, "typed_id").withColumnRenamed("typed_id", "target_thread")


def with_post(records: DataFrame, posts: DataFrame, columns: list[str]) -> DataFrame:
    """Records with post_<column> of the post of their thread; nulls where it was not collected."""
    own = posts.select(F.col("typed_id").alias("thread_id"), *[F.col(c).alias(f"post_{c}") for c in columns])
    return records.join(own, "thread_id", "left")


def families(hits: DataFrame, phrases: DataFrame) -> DataFrame:
    """(typed_id, family) of the sheets that a record's matched phrases come from. phrases: query_id, sheet."""
    return hits.join(phrases.select("query_id", F.col("sheet").alias("family")).distinct(), "query_id").select("typed_id", "family").distinct()


def union_of(*parts: DataFrame) -> DataFrame:
    """Distinct rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def add_targets(held: DataFrame, new: DataFrame, room: int) -> DataFrame:
    """held and the smallest of the new targets, at most room in all; one column each."""
    left = max(0, room - held.count())
    name = held.columns[0]
    more = new.toDF(name).where(F.col(name).isNotNull()).distinct().join(held, name, "left_anti")
    return held.unionByName(more.orderBy(name).limit(left))


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; ranks are bounded before the shuffle, so a large group costs n rows a task."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def round_robin(groups: DataFrame, strata: list[str], seq: str, most: int) -> DataFrame:
    """At most `most` groups, one of each stratum a lap, with their place; strata in order of their values, groups by seq.

    A stratum gives at most `most` groups, so ranks are bounded before the shuffle, and so is the final order."""
    lap = first_of(groups, strata, [F.col(seq)], most, "lap")
    top = lap.orderBy("lap", *strata, seq).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("lap", *strata, seq))).drop("lap")  # `most` rows


def month_choice(files: DataFrame) -> DataFrame:
    """(kind, first_month, middle_month, last_month) of each kind's months; the middle one is at size // 2."""
    m = F.sort_array(F.collect_set("month"))  # months of a kind: a few hundred
    return files.where("month IS NOT NULL").groupBy("kind").agg(m.alias("m")).select(
        "kind", F.element_at("m", 1).alias("first_month"), F.element_at("m", (F.size("m") / 2).cast("int") + 1).alias("middle_month"), F.element_at("m", -1).alias("last_month")
    )


def context_order() -> list[Column]:
    """Context files: submissions first, then by month and path."""
    return [F.col("kind") != "submissions", F.col("month"), F.col("path")]


def post_order() -> list[Column]:
    """Posts by time, unknown first as the epoch, then by id."""
    return [F.coalesce("created_utc", F.lit(0)), F.col("typed_id")]


def calibration_first(ids: list[str], key: str) -> list[Column]:
    return [~F.col(key).isin(ids), F.col(key)]


def last_errors(errors: Column, n: int = 100) -> Column:
    """The last n of an array."""
    return F.slice(errors, F.greatest(F.size(errors) - n + 1, F.lit(1)), F.lit(n))


def first_or_own(rows: DataFrame, key: str, wanted: Column, order: Column, own: Column) -> DataFrame:
    """(key, original): of each key's rows the smallest `order` among the wanted, else the smallest `own`. Combines before the shuffle."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(wanted, order)), F.min(own)).alias("original"))


#: what a classifier is shown of a record; fixed values of the review contract
CASE_FIELDS = ("typed_id", "thread_id", "parent_id", "kind", "author", "subreddit", "created_utc", "title", "selftext", "body", "canonical_permalink")


def input_records(records: DataFrame) -> DataFrame:
    """records with CASE_FIELDS only, as JSON objects: (typed_id, thread_id, record). Absent fields are null, and say so."""
    fields = [(F.col(c) if c in records.columns else F.lit(None).cast("string")).alias(c) for c in CASE_FIELDS]
    return records.select("typed_id", "thread_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The physically first n rows of each file under path, with _file and _row (from 0): the same rows in every run."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).where(F.col("_row") < n)


def merged(a: Column, b: Column) -> Column:
    """One map of both; b's values win, keys of a come first. A null map counts as empty."""
    kind = "map<string,string>"
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(a.cast(kind), none), F.coalesce(b.cast(kind), none)
    return F.map_concat(F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.element_at(b, k)).otherwise(v)), F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def clamp(value: Column, low: float, high: float) -> Column:
    """value within its bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def file_name(title: Column) -> Column:
    """The file name of a sheet's title: lower case, blanks as underscores."""
    return F.regexp_replace(F.lower(title), " ", "_")


def memberships(run_id: str, stage: str, reason: Column, records: DataFrame) -> DataFrame:
    """membership_id, run_id, record_id, post_id, stage, reason: one for each record of a run's stage. post_id is null for a record whose submission is not here; none is made up.

    records: typed_id, thread_id, kind."""
    rows = records.select(F.lit(run_id).alias("run_id"), F.col("typed_id").alias("record_id"), F.col("thread_id").alias("post"), F.lit(stage).alias("stage"), reason.alias("reason")).dropDuplicates(["record_id"])
    posts = records.where("kind = 'submissions'").select(F.col("typed_id").alias("post"), F.col("typed_id").alias("post_id")).distinct()
    ident = F.concat(F.lit("m_"), F.substring(F.sha2(F.concat_ws("\x1f", "run_id", "record_id", "stage"), 256), 1, 20))
    return rows.join(posts, "post", "left").select(ident.alias("membership_id"), "run_id", "record_id", "post_id", "stage", "reason")


def classifications(decisions: DataFrame) -> DataFrame:
    """record_id, label (Yes, No or Uncertain; null where the execution did not complete), execution_status, error, score, score_kind (none without a score).

    decisions: record_id, label (Unsure for undecided), status (completed, failed, not_run), error, score. Missing context never makes a label."""
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    label = F.when(done, F.when(F.col("label").isin("Yes", "No"), F.col("label")).otherwise("Uncertain"))
    return decisions.select("record_id", label.alias("label"), F.coalesce("status", F.lit("not_run")).alias("execution_status"), F.when(~done, F.col("error")).alias("error"), F.when(done, F.col("score")).alias("score"), F.when(done & F.col("score").isNotNull(), "uncalibrated").otherwise("none").alias("score_kind"))
