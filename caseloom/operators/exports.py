"""Export tables: global row numbers, workbook parts, overlong cells, evidence and incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import text_parts, utf16_units
from caseloom.plans.scratch import unused, written

# fixed values of the export contract
CELL_UNITS, PART_CHARS = 30000, 14000


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """df with global row numbers from 1 in the given total order, without a window over all rows in one task.

    Rows are sorted by ranges into a written table; each range's offset is the sum of the counts before it (one
    number for each shuffle partition reaches the driver).
    """
    spark = df.sparkSession
    at, nth, before_ = unused(df, "_range", "_rn", "_before")
    placed = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the low 33 bits count the rows of a partition
    placed = written(placed.withColumns({at: F.spark_partition_id(), nth: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1}), "numbered")
    total, before = 0, []
    for r in placed.groupBy(at).count().orderBy(at).collect():
        before.append((r[at], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, f"{at} int, {before_} long")
    return placed.join(F.broadcast(offsets), at).withColumn(name, F.col(before_) + F.col(nth)).drop(at, before_, nth)


def workbook_parts(rows: DataFrame, max_rows: int, row_number: str = "row_number") -> DataFrame:
    """rows with their 1-based workbook part."""
    return rows.withColumn("part", F.floor((F.col(row_number) - 1) / max_rows).cast("long") + 1)


def part_ranges(tables: dict[str, DataFrame], max_rows: int) -> DataFrame:
    """(table_name, part, first_row, last_row) for every table and part up to the longest table's last; null where a table has no rows left."""
    spark = next(iter(tables.values())).sparkSession
    counts = [(n, t.count()) for n, t in tables.items()]
    parts = max(1, max(-(-c // max_rows) for _, c in counts))
    at = spark.createDataFrame(counts, "table_name string, n long").select("table_name", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"))
    first, here = F.col("i") * max_rows + 1, F.col("i") * max_rows < F.col("n")
    return at.select("table_name", (F.col("i") + 1).cast("long").alias("part"), F.when(here, first).cast("long").alias("first_row"), F.when(here, F.least(F.col("n"), first + max_rows - 1)).alias("last_row"))


def overlong_cells(rows: DataFrame, row: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with cells over CELL_UNITS UTF-16 units replaced by a reference, and (cell_row, cell_column, part, value) of their texts."""
    over = lambda c: F.coalesce(utf16_units(F.col(c)) > CELL_UNITS, F.lit(False))
    kept = rows.withColumns({c: F.when(over(c), F.concat(F.lit("See Text parts: "), F.col(row).cast("string"), F.lit(f"/{c}"))).otherwise(F.col(c)) for c in columns})
    cells = F.array_compact(F.array(*[F.when(over(c), F.struct(F.lit(c).alias("cell_column"), F.col(c).alias("value"))) for c in columns]))
    parts = rows.select(F.col(row).alias("cell_row"), F.explode(cells).alias("c")).select("cell_row", "c.cell_column", F.posexplode(text_parts(F.col("c.value"), PART_CHARS)).alias("part", "value"))
    return kept, parts.withColumn("part", F.col("part").cast("long") + 1)


def disposition(label: Column, status: Column) -> Column:
    pending = F.coalesce(F.startswith(status, F.lit("pending")), F.lit(True))
    return F.when(pending, "Pending review").when(label == "Yes", "Reported event").otherwise(F.concat(F.lit("Reviewed "), label))


def annotation_rank(label: Column, status: Column) -> list[Column]:
    """Sort keys: reviewed first, then Yes, No, Unsure."""
    return [F.coalesce(F.startswith(status, F.lit("pending")), F.lit(True)), F.when(label == "Yes", 0).when(label == "No", 1).otherwise(2)]


def evidence_table(annotations: DataFrame) -> DataFrame:
    """One row per piece of evidence, with its incident."""
    return annotations.select("incident_id", F.explode("evidence").alias("e")).select("incident_id", "e.*")


def last_seed(annotations: DataFrame) -> DataFrame:
    """(incident_id, seed_record_id): the last of each incident's seeds; incidents without seeds have no row."""
    return annotations.where(F.size("seed_record_ids") > 0).select("incident_id", F.element_at("seed_record_ids", -1).alias("seed_record_id"))


def joined_values(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct non-null values in order of first appearance, joined by '; '. Values are combined before the shuffle."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda s: s["v"])).alias("values"))


def posts_catalog(posts: DataFrame, reviews: DataFrame) -> DataFrame:
    """posts with labels, statuses and incident_ids of the annotations that name them, and the order of the first of these as place_rank, place_id.

    reviews: incident_id, label, review_status, post_ids (seeds and series). Posts that none names are 'Not a keyword candidate' and come last.
    """
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(annotation_rank(F.col("label"), F.col("review_status")))])
    each = reviews.select(F.explode(F.array_distinct("post_ids")).alias("typed_id"), F.struct(rank.alias("rank"), "incident_id", "label", "review_status").alias("a"))
    per = each.groupBy("typed_id").agg(F.sort_array(F.collect_list("a")).alias("a"))  # annotations of one post
    text = lambda f: F.array_join(F.array_distinct(F.transform("a", lambda x: x[f])), "; ")
    named = per.select("typed_id", text("label").alias("labels"), text("review_status").alias("statuses"), text("incident_id").alias("incident_ids"), F.element_at("a", 1)["incident_id"].alias("place_id"), F.element_at("a", 1)["rank"].alias("place_rank"))
    out = posts.join(named, "typed_id", "left")
    return out.withColumns({"labels": F.coalesce("labels", F.lit("Not a keyword candidate")), "statuses": F.coalesce("statuses", F.lit("")), "incident_ids": F.coalesce("incident_ids", F.lit("")), "place_id": F.coalesce("place_id", "typed_id")})


def summary_table(hits: DataFrame, checkpoints: DataFrame, annotations: DataFrame) -> DataFrame:
    """(measure, value) of the summary sheet. hits: typed_id, thread_id; checkpoints: stage, status, scanned; annotations: label, review_status."""
    h = hits.agg(F.countDistinct("typed_id").alias("records"), F.countDistinct("thread_id").alias("threads"))
    c = checkpoints.agg(F.coalesce(F.sum(F.when((F.col("stage") == "discovery") & (F.col("status") == "complete"), F.col("scanned"))), F.lit(0)).alias("scanned"))
    pending = F.coalesce(F.startswith("review_status", F.lit("pending")), F.lit(True))
    a = annotations.agg(
        F.count("*").alias("cases"), F.count_if(F.col("label") == "Yes").alias("yes"), F.count_if(F.col("label") == "No").alias("no"), F.count_if((F.col("label") == "Unsure") & ~pending).alias("unsure"), F.count_if(pending).alias("pending")
    )
    names = {
        "scanned": "Completed discovery checkpoint rows (scopes may overlap)", "records": "Unique keyword-matching records", "threads": "Unique keyword-hit threads", "cases": "Provisional case units",
        "yes": "Reviewed Yes", "no": "Reviewed No", "unsure": "Reviewed Unsure", "pending": "Awaiting model review",
    }
    one = h.crossJoin(c).crossJoin(a)  # of one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(k).cast("long").alias("value")) for k, v in names.items()])).alias("x")).select("x.*")
