"""Monthly Parquet shards as data sources: records and footers, pruned by kind and month before any file is opened.

spark.read.format("shards").load(root) reads records, spark.read.format("shard_footers").load(root) one row for each shard: bytes, rows, row groups and the type of each column.
The options kinds (comma-separated), start and end (first and last month) decide which folders are listed. Filters are not pushed to the source: Spark 4.1 keeps what one DataFrame pushes for every other
one made from the same load, whose rows would then be missing. A schema given to the reader names the columns that are read (Python sources are not pruned by Spark);
without one it is the union over six footers, the first, middle and last month of each kind. Columns that a shard lacks are null, numbers are widened, other types that differ are text.
A shard is cut into pieces of `split_bytes` (128 MiB), each reading the row groups that begin in it; footers are opened by tasks, `files_per_task` (64) at a time, never by the driver beyond the six.
The store must be one that pyarrow's file systems open. A folder without shards gives no rows; one without footers to take a schema from needs a schema.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from caseloom.plans.scratch import new_folder, unused
from caseloom.plans.versions import Folder

PLACE = ("kind", "month", "source_path")
FOOTER = "kind string, month string, source_path string, bytes long, rows long, row_groups int, columns map<string,string>"
#: rows of a batch that is handed to Spark
ROWS = 1000


@dataclass
class Scope:
    """Options of a read: kinds (comma-separated), start and end (first and last month, YYYY-MM). Absent ones restrict nothing."""

    kinds: tuple[str, ...] = ()
    start: str = ""
    end: str = ""

    @classmethod
    def of(cls, options) -> Scope:
        return cls(tuple(k for k in options.get("kinds", "").split(",") if k), options.get("start", ""), options.get("end", ""))

    def has_kind(self, kind: str) -> bool:
        return kind in ("comments", "submissions") and (not self.kinds or kind in self.kinds)

    def has_month(self, month: str) -> bool:
        return bool(re.fullmatch(r"\d{4}-\d\d", month)) and self.start <= month and (not self.end or month <= self.end)


@dataclass
class Shard(InputPartition):
    kind: str
    month: str
    path: str
    bytes: int
    begin: int = 0
    end: int = 0


@dataclass
class Shards(InputPartition):
    shards: list[Shard]


def store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:/", root) else (pafs.LocalFileSystem(), root)


def _below(fs: pafs.FileSystem, path: str, folders: bool) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((i for i in found if (i.type == pafs.FileType.Directory) == folders), key=lambda i: i.path)


def listed(root: str, scope: Scope | None = None) -> list[Shard]:
    """The shards below root, one entry each; folders of other kinds and months are not listed."""
    fs, base = store(root)
    out, scope = [], scope or Scope()
    for kind in _below(fs, posixpath.join(base, "data"), True):
        if scope.has_kind(kind.base_name):
            for year in _below(fs, kind.path, True):
                for month in _below(fs, year.path, True):
                    name = f"{year.base_name}-{month.base_name}"
                    if scope.has_month(name):
                        out += [Shard(kind.base_name, name, posixpath.relpath(f.path, base), f.size) for f in _below(fs, month.path, False) if f.extension == "parquet"]
    return out


def _footer(fs: pafs.FileSystem, base: str, shard: Shard) -> pq.FileMetaData:
    with fs.open_input_file(posixpath.join(base, shard.path)) as f:
        return pq.read_metadata(f)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()]
    order_of = {t: i for i, t in enumerate(order)} | {T.FloatType(): 4}
    return order[max(order_of[a], order_of[b])] if a in order_of and b in order_of else T.StringType()


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> T.StructType:
        root = self.options["path"]
        fs, base = store(root)
        shards, types = listed(root, Scope.of(self.options)), {}
        for kind in ("comments", "submissions"):
            months = sorted({s.month for s in shards if s.kind == kind})
            for month in {months[0], months[len(months) // 2], months[-1]} if months else ():
                for f in _footer(fs, base, next(s for s in shards if (s.kind, s.month) == (kind, month))).schema.to_arrow_schema():
                    t = from_arrow_type(f.type, prefer_timestamp_ntz=True)
                    types[f.name] = _wider(types[f.name], t) if f.name in types else t
        if not types:
            raise ValueError(f"no shard under {root} to take columns from: give a schema")
        out = T.StructType([T.StructField(n, T.StringType()) for n in PLACE])
        return T.StructType(out.fields + [T.StructField(n, types[n]) for n in sorted(types) if n not in PLACE])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShardReader(self.options["path"], schema, Scope.of(self.options), int(self.options.get("split_bytes", 128 << 20)))


class ShardReader(DataSourceReader):
    def __init__(self, root: str, schema: T.StructType, scope: Scope, split: int):
        self.root, self.schema, self.scope, self.split = root, schema, scope, max(split, 1)

    def partitions(self) -> list[InputPartition]:
        cut = range(0, 1 << 62, self.split)
        return [Shard(s.kind, s.month, s.path, s.bytes, cut[i], cut[i + 1]) for s in listed(self.root, self.scope) for i in range(-(-s.bytes // self.split))] or [Shard("", "", "", 0)]

    def read(self, p: Shard) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        fs, base = store(self.root)
        names, kinds = self.schema.names, [to_arrow_type(f.dataType) for f in self.schema]
        fixed = {"kind": p.kind, "month": p.month, "source_path": p.path}
        with fs.open_input_file(posixpath.join(base, p.path)) as f:
            file = pq.ParquetFile(f)
            held = [n for n in names if n not in fixed and n in file.schema_arrow.names]
            groups = [g for g in range(file.num_row_groups) if p.begin <= _start(file.metadata.row_group(g)) < p.end]
            sizes = [(n, None) for g in groups for n in _steps(file.metadata.row_group(g).num_rows)] if not held else ((b.num_rows, b) for b in file.iter_batches(ROWS, groups, held))
            for n, b in sizes:
                yield pa.RecordBatch.from_arrays([pa.array([fixed[c]] * n, pa.string()) if c in fixed else b.column(c).cast(t) if c in held else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)


def _start(group: pq.RowGroupMetaData) -> int:
    c = group.column(0)
    return min(c.data_page_offset, c.dictionary_page_offset) if c.has_dictionary_page else c.data_page_offset


def _steps(rows: int) -> Iterator[int]:
    for at in range(0, rows, ROWS):
        yield min(ROWS, rows - at)


class FooterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shard_footers"

    def schema(self) -> str:
        return FOOTER

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FooterReader(self.options["path"], Scope.of(self.options), int(self.options.get("files_per_task", 64)))


class FooterReader(DataSourceReader):
    def __init__(self, root: str, scope: Scope, step: int):
        self.root, self.scope, self.step = root, scope, max(step, 1)

    def partitions(self) -> list[InputPartition]:
        shards = listed(self.root, self.scope)
        return [Shards(shards[i : i + self.step]) for i in range(0, len(shards), self.step)] or [Shards([])]

    def read(self, p: Shards) -> Iterator[tuple]:
        fs, base = store(self.root)
        for s in p.shards:
            m = _footer(fs, base, s)
            yield s.kind, s.month, s.path, s.bytes, m.num_rows, m.num_row_groups, {f.name: from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString() for f in m.schema.to_arrow_schema()}


def register(spark: SparkSession) -> None:
    """Makes the formats shards and shard_footers known to the session."""
    for source in (ShardSource, FooterSource):
        spark.dataSource.register(source)


def write_shards(df: DataFrame, root: str) -> None:
    """df (kind, month as YYYY-MM, further columns) as shards data/KIND/YYYY/MM/part-*.parquet below root, beside those that are there.

    Files are written to a folder of their own first and renamed once all are whole. Rows whose kind or month is null or of another form are an error: no path holds them.
    """
    spark, part = df.sparkSession, f"pending-{new_folder(df.sparkSession, 'shards').rsplit('/', 1)[-1]}"
    kind, month = unused(df, "_kind", "_month")
    good = F.col("kind").isin("comments", "submissions") & F.col("month").rlike(r"^\d{4}-\d\d$")
    place = F.when(F.coalesce(good, F.lit(False)), F.col("kind")).otherwise(F.raise_error(F.lit("a record without kind or month has no shard")))
    df.withColumns({kind: place, month: F.replace("month", F.lit("-"), F.lit("/"))}).drop("kind", "month").hint("rebalance", kind, month).write.partitionBy(kind, month).option("compression", "zstd").parquet(f"{root.rstrip('/')}/{part}")
    folder = Folder(spark, root)
    for k in (n for n in folder.names(part) if "=" in n):
        for m in folder.names(f"{part}/{k}"):
            to = f"data/{k.split('=')[1]}/{m.split('=')[1].replace('%2F', '/')}"
            for f in folder.names(f"{part}/{k}/{m}"):
                folder.move(f"{part}/{k}/{m}/{f}", f"{to}/{f}")
    folder.delete(part)


def presence(footers: DataFrame) -> DataFrame:
    """(kind, column, shards, absent, first_month, last_month, types) of every column of a kind: how many shards hold it, how many do not, and its types, sorted. Footers only; combined before the shuffle."""
    each = footers.select("kind", "month", F.explode("columns").alias("column", "type"))
    held = each.groupBy("kind", "column").agg(F.count("*").alias("shards"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.array_sort(F.collect_set("type")).alias("types"))
    total = footers.groupBy("kind").agg(F.count("*").alias("total"))
    return held.join(F.broadcast(total), "kind").select("kind", "column", "shards", (F.col("total") - F.col("shards")).alias("absent"), "first_month", "last_month", "types")


def kinds_apart(footers: DataFrame) -> DataFrame:
    """(month, only) of months that only comments or only submissions have."""
    return footers.groupBy("month").agg(F.min("kind").alias("only"), F.max("kind").alias("other")).where("only = other").select("month", "only")
