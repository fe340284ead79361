"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans, leftmost and non-overlapping per kind (offsets in code points, end exclusive):
  assign  name = value with a value of 8 characters or more
  access  AKIA..., 16 characters or more
  hex     32 lower-case hex digits or more
Linked spans, reported only where complementary parts co-occur:
  secret    a run of exactly 40 base64 characters with upper, lower case and a digit, in the scope of an access
            identifier; any other character may stand next to it (KEY=value, end of a sentence, query of a URL)
  endpoint  a URL or cloud host in the scope of an access identifier that also holds a secret or assign span

A scope is the access identifier's span widened by `reach` code points on both sides; overlapping scopes of a text are
merged first, so the interval join (equal row and bucket, then containment) gives a part one scope at
most and its output follows its input. Parts that touch a base span are not reported again.

Matching positions come from the lengths of the pieces around the matches; texts without a match are
settled by one test per kind. Arrays are built in blocks and texts are cut in pieces of CHUNK code points, so time grows
with a text's length and its number of matches, not with their product.

Edge cases: null and empty texts have no spans; repeated rows are scanned alike; a null doc_id is kept;
clashing names of extra columns are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm._common import materialize, table, unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"https?://[^\s\"'<>]+|\b[a-z0-9][a-z0-9.-]*\.(?:amazonaws\.com|cloudfront\.net|core\.windows\.net|googleapis\.com)\b"
#: order of kinds at one start
KINDS = ("assign", "access", "hex", "secret", "endpoint")
ITEM = "struct<start:int,rank:int,kind:string,end:int>"
SPAN = f"array<{ITEM}>"


BLOCK, CHUNK = 128, 4096


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scan(items: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays that step(at, item) -> (next at, array) gives along items, joined; at is an int and starts at 0.
    Arrays grow within a block only, and by blocks: appending one by one would copy all that came before each time."""
    none = F.array().cast(f"array<{out}>")

    def inner(acc: Column, x: Column) -> Column:
        at, more = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def whole(x: Column) -> Column:
        def outer(acc: Column, b: Column) -> Column:
            block = F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
            return _with(block, lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), begin, outer, lambda acc: F.flatten(acc["out"]))

    return _with(items, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def _spans(text: Column, kind: str, pattern: str, value_group: int | None = None, least: int = 1) -> Column:
    """Spans of all matches whose value group (or whole) has at least `least` characters."""
    p, rank = F.lit(pattern), KINDS.index(kind)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    found = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    if value_group:
        values = F.transform(F.regexp_extract_all(text, p, F.lit(value_group)), F.length)
        found = F.zip_with(found, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), v.alias("value")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return end, F.when(F.coalesce(x["value" if value_group else "hit"], F.lit(0)) >= least, F.array(span)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(pattern), _scan(found, ITEM, step)).otherwise(F.array().cast(SPAN))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _base(text: Column) -> dict[str, Column]:
    return {"assign": _spans(text, "assign", ASSIGN, 2, 8), "access": _spans(text, "access", ACCESS), "hex": _spans(text, "hex", HEX)}


def _parts(text: Column) -> Column:
    """Candidates for linking that touch no base span; only looked for beside an access identifier."""
    loose = F.concat(_spans(text, "secret", SECRET), _spans(text, "endpoint", ENDPOINT))
    base, some = F.concat("assign", "access", "hex"), F.array().cast(SPAN)
    is_base = lambda s: s["rank"] <= 2
    last = 1 << 30

    def after(at: Column, s: Column) -> tuple[Column, Column]:  # at: where the base spans so far end
        return F.when(is_base(s), F.greatest(at, s["end"])).otherwise(at), F.when(is_base(s) | (s["start"] >= at), F.array(s)).otherwise(some)

    def before(at: Column, s: Column) -> tuple[Column, Column]:  # at: last - where the next base span starts, 0 if there is none
        return F.when(is_base(s), F.lit(last) - s["start"]).otherwise(at), F.when(~is_base(s) & ((at == 0) | (s["end"] <= F.lit(last) - at)), F.array(s)).otherwise(some)

    free = _with(F.sort_array(F.concat(base, loose)), lambda x: _scan(F.sort_array(_scan(x, ITEM, after), asc=False), ITEM, before))
    return F.when(F.size("access") > 0, free).otherwise(some)


def _link(rows: DataFrame, reach: int) -> DataFrame:
    """(row, linked) for rows (row, assign, access, parts) with something to report."""
    some = rows.where(F.size("parts") > 0)
    order = W.partitionBy("row").orderBy("lo", "hi")
    scopes = (
        some.select("row", F.explode("access").alias("a"))
        .select("row", F.greatest(F.col("a.start") - reach, F.lit(0)).alias("lo"), (F.col("a.end") + reach).alias("hi"))
        .withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
        .withColumn("scope", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("row", "scope").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor(F.col("hi") / reach))))
    )
    parts = some.select("row", F.explode(F.concat("parts", "assign")).alias("s")).withColumn("bucket", F.floor(F.col("s.start") / reach))
    inside = parts.join(scopes, ["row", "bucket"]).where("s.start >= lo AND s.end <= hi")
    inside = inside.withColumn("keyed", F.max(F.col("s.kind").isin("secret", "assign")).over(W.partitionBy("row", "scope")))
    found = inside.where("s.kind = 'secret' OR (s.kind = 'endpoint' AND keyed)")
    return found.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("linked"))


def scan_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans (array of start, rank, kind, end) for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("_t")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns(_base(F.col("_t"))).withColumn("parts", _parts(F.col("_t"))).drop("_t")
    rows = materialize(rows, "spans")  # fixes row, and the texts are read once
    linked = materialize(_link(rows, reach), "linked")
    base = F.sort_array(F.concat("assign", "access", "hex"))
    return rows.join(linked, "row", "left").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
        F.sha2(_text(base), 256).alias("base_sha256"),
        F.sort_array(F.concat(base, F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """docs with every span in text replaced by [kind]; all columns and rows kept. Texts without an
    access identifier are settled in place; only the others meet the linked spans in a join."""
    has = F.coalesce(F.contains(F.col("text"), F.lit("AKIA")), F.lit(False))
    plain = docs.where(~has).withColumn("text", _redacted(F.concat(*_base(F.coalesce("text", F.lit(""))).values())))
    some = docs.where(has)
    own_id, own_hash, found = unused(docs, "_id", "_hash", "_spans")
    rows = some.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("row"), F.col("text").alias("_t"))
    rows = materialize(rows.withColumns(_base(F.col("_t"))).withColumn("parts", _parts(F.col("_t"))).drop("_t").dropDuplicates(["row"]), "spans")
    linked = _link(rows, reach)
    spans = rows.join(linked, "row", "left").select(
        F.col("row.id").alias(own_id), F.col("row.hash").alias(own_hash), F.concat("assign", "access", "hex", F.coalesce("linked", F.array().cast(SPAN))).alias(found)
    )
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash))
    some = some.join(spans, on, "left").withColumn("text", _redacted(F.col(found))).select(*docs.columns)
    return plain.select(*docs.columns).unionByName(some)


def _redacted(spans: Column) -> Column:
    """text with the spans replaced; of overlapping spans the first names the kind."""

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(chunks, i + 1, j - i + 1), ""), a - i * CHUNK + 1, b - a)

    def whole(chunks: Column, s: Column) -> Column:
        step = lambda at, x: (F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(F.concat(cut(chunks, at, x["start"]), F.lit("["), x["kind"], F.lit("]")))).otherwise(F.array().cast("array<string>")))
        return F.concat(F.array_join(_scan(s, "string", step), ""), cut(chunks, F.array_max(F.transform(s, lambda x: x["end"])), F.length("text")))

    chunks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _with(F.struct(chunks.alias("c"), F.sort_array(spans).alias("s")), lambda x: whole(x["c"], x["s"]))).otherwise(F.col("text"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).withColumn("spans", _text(F.col("spans")))
