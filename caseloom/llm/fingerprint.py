"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words (runs of characters other than space and U+0009..U+000D), a term's weight
is its count. Each of `samples` samples draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from a hash of (term, sample),
quantises the weight s to t = floor(ln s / r + b), y = exp(r (t - b)), and keeps the term and t with the smallest
a = c / (y exp r). Two texts agree in a sample with the probability of their generalised Jaccard similarity, the sum of the smaller
over the sum of the larger weights.

r b and r (1 - b) are two independent exponential variates, -ln u2 and -ln u1. So a = c u1 (u1 u2)^t, t is 0
where s u1 < 1 (always, for a weight of 1), and a alone identifies term and t: the kept minimum is the sample.
A fingerprint holds 16 bits of a hash of each sample as 4 hex digits; different samples agree by chance once in 65,536.

Each document is also compared with the next one by descending doc_id. Documents are dealt into ranges of doc_id
(`ranges` for each shuffle partition, from approximate percentiles) and every range also gets a copy of the row that follows it,
so one exchange of the texts serves the order, the terms, their weights and the samples: all of these are grouped
within a range. Only ids (two numbers for each range) reach the driver.

Edge cases: null and empty texts have no words and the fingerprint ''; two of these are alike (1.0), one of them and another text are not (0.0). Null
doc_ids come last; equal doc_ids are ordered by a hash of the text, then the text; repeated rows follow each other and each has a row.
A single document is its own next. Rows that are equal in doc_id and text share a task. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm._common import materialize, table

BLANK = r"[\x20\x09-\x0D]+"
SAMPLES = 64
RANGES = 32


def word_terms(rows: DataFrame, key: list[str], parts: list[tuple[Column, list[int]]], texts: int) -> DataFrame:
    """key, term, n0, n1 ...: how often each word is in each text.

    parts: pieces of texts that end at blanks or the text's end, and the numbers of the texts that have the piece, so what texts share is split once."""
    held = [f"i{j}" for j in range(texts)]
    each = F.explode(F.array(*[F.struct(part.alias("part"), *[F.lit(int(j in of)).alias(i) for j, i in enumerate(held)]) for part, of in parts]))
    said = rows.select(*key, each.alias("x")).select(*key, *[F.col(f"x.{i}").alias(i) for i in held], F.explode(F.split("x.part", BLANK, -1)).alias("word")).where("word <> ''")
    return said.groupBy(*key, F.xxhash64("word").alias("term")).agg(*[F.sum(i).alias(f"n{j}") for j, i in enumerate(held)])


def _sample(k: int) -> Column:
    """a of sample k for the columns term and s. t is at least j where s u1^j u2^(j - 1) is not under 1; beyond 2 logarithms find it."""
    h, g = F.xxhash64("term", F.lit(k)), F.xxhash64("term", F.lit(k), F.lit(1))
    u1 = (F.shiftrightunsigned(h, 32) + 0.5) * 2.0**-32
    c = -F.ln((F.shiftright(h, 16).bitwiseAND(F.lit(0xFFFF)) + 0.5) * (h.bitwiseAND(F.lit(0xFFFF)) + 0.5) * 2.0**-32)
    u2 = (F.shiftrightunsigned(g, 12) + 0.5) * 2.0**-52
    both = u1 * u2
    t = F.floor((F.ln("s") - F.ln(u2)) / -F.ln(both))
    return c * u1 * F.when(F.col("s") * u1 < 1, F.lit(1.0)).when(F.col("s") * u1 * both < 1, both).when(F.col("s") * u1 * both * both < 1, both * both).otherwise(F.pow(both, t))


def weighted_samples(terms: DataFrame, key: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """key and for each weight column an array of the same name: 16 bits of each sample of the terms whose weight is over 0, null without terms.

    terms: key, term (long), weights. A term is sampled once for each of its different weights; of the texts that have it with
    this weight, `texts` holds a bit each. The samples stand in the aggregates themselves, where the generated code is one small method each."""
    one = lambda w: F.struct(F.col(w).alias("s"), sum((F.when(F.col(v) == F.col(w), 1 << j).otherwise(0) for j, v in enumerate(weights)), F.lit(0)).alias("texts"))
    drawn = terms.select(*key, "term", F.explode(F.array_distinct(F.array(*[one(w) for w in weights]))).alias("x")).where("x.s > 0").select(*key, "term", "x.s", "x.texts")
    least = drawn.groupBy(*key, "texts").agg(*[F.min(_sample(k)).alias(f"a{k}") for k in range(samples)])
    least = least.groupBy(*key).agg(F.collect_list(F.struct("texts", F.array(*[f"a{k}" for k in range(samples)]).alias("a"))).alias("x"))  # 2 ** texts - 1 rows at most

    def of(j: int) -> Column:
        each = F.transform(F.filter("x", lambda x: x["texts"].bitwiseAND(F.lit(1 << j)) > 0), lambda x: x["a"])
        both = F.aggregate(F.slice(each, 2, len(weights) ** 2), F.element_at(each, 1), lambda a, b: F.zip_with(a, b, lambda p, q: F.least(p, q)))
        return F.when(F.size(each) > 0, F.transform(both, lambda v: F.pmod(F.xxhash64(v), F.lit(1 << 16)).cast("int")))

    return least.select(*key, *[of(j).alias(w) for j, w in enumerate(weights)])


def as_text(signature: Column) -> Column:
    """4 hex digits for each sample; '' without terms."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree, 1 if neither text has terms, 0 if only one has."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same / F.size(a))


def fingerprints(rows: DataFrame, key: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key, fingerprint of any table whose key is unique and not null; rows whose text has no words are left out."""
    got = weighted_samples(word_terms(rows, key, [(F.col(text), [0])], 1), key, ["n0"], samples)
    return got.select(*key, as_text(F.col("n0")).alias("fingerprint"))


def _range_of(bounds: list[int]) -> Column:
    """How many of the sorted bounds are no larger than doc_id: coarse steps first. -1 for null."""
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    fine = F.split(F.lit(";".join(",".join(map(str, bounds[i : i + step])) for i in range(0, len(bounds), step))), ";")
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col("doc_id")))
    coarse = F.greatest(below(array(bounds[::step])), F.lit(1))
    return F.coalesce((coarse - 1) * step + below(F.split(F.element_at(fine, coarse), ",").cast("array<bigint>")), F.lit(-1))


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, after: after is 0 for every row and 1 for a copy of the row that follows a range's last."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, ranges * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 20 * n).alias("p")).first()["p"] or [0]
    rows = rows.withColumn("range", _range_of(sorted(set(bounds))))
    firsts = sorted(((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.max("doc_id").alias("first")).collect()), reverse=True)
    before = spark.createDataFrame([(b, i, firsts[at - 1][0]) for at, (b, i) in enumerate(firsts)], "range int, first long, before int")
    first = rows.join(F.broadcast(before), "range").where(F.col("doc_id").eqNullSafe(F.col("first")))  # a row for each range, or few
    first = first.groupBy("before").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.max("doc_id").alias("doc_id"))
    copies = first.select("doc_id", "x.text", F.col("before").alias("range"), F.lit(1).alias("after"))
    # a plain table, and no null range that only one side of the join below would filter: so both sides share one exchange of the texts
    copies = materialize(copies, "following").withColumn("range", F.coalesce("range", F.lit(-1)))
    # as many tasks as asked for: few bytes of text are much work
    return rows.withColumn("after", F.lit(0)).unionByName(copies).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range")


def compare_edits(docs: DataFrame, samples: int = SAMPLES, ranges: int = RANGES) -> DataFrame:
    """Every document's fingerprint beside that of its edited text, whose last half of the code points is replaced by as many of the next document's first.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = W.partitionBy("range").orderBy("after", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    cut = lambda c, i, k: F.substring(F.col(c), i, k)
    rows = _in_ranges(docs, ranges).withColumns({"at": F.row_number().over(order), "follows": F.lead("text").over(order)})
    rows = rows.withColumns({"head": cut("text", F.lit(1), n - half), "tail": cut("text", n - half + 1, half), "new": F.when(F.col("after") == 0, cut("follows", F.lit(1), half))})
    whole = F.regexp_extract("head", r"(?s)^(.*[\x20\x09-\x0D])?", 0)  # up to the last blank: a word may go on in what follows
    key = ["range", "at"]
    split = rows.select(*key, whole.alias("whole"), "head", "tail", "new").select(*key, "whole", F.substring("head", F.length("whole") + 1, F.length("head")).alias("seam"), "tail", "new")
    terms = word_terms(split, key, [(F.col("whole"), [0, 1]), (F.concat("seam", "tail"), [0]), (F.concat("seam", "new"), [1])], 2)
    drawn = weighted_samples(terms, key, ["n0", "n1"], samples)
    about = rows.select(*key, "after", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.concat("head", "new"), 256).alias("edited_sha256"))
    out = about.join(drawn, key, "left").withColumn("n2", F.lead("n0").over(W.partitionBy("range").orderBy("at"))).where("after = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("n0")).alias("fingerprint"), as_text(F.col("n1")).alias("edited_fingerprint"),
        likeness(F.col("n0"), F.col("n1")).alias("near_edited"), likeness(F.col("n0"), F.col("n2")).alias("near_next"),
    )


def op12_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
