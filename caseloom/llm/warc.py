"""WARC: one gzip member per record, written to shared storage and read back sequentially.

Writing: of the records with equal payloads of min_payload bytes or more the one with the smallest
page_id is a response, the others are revisits that refer to it and carry no payload. Digests are
grouped before anything else moves; only repeated ones are joined to the pages, so a payload that a third of all
pages share is split like any skewed join (null and small payloads join under keys of their own). Each task writes archives of about file_bytes under names of its own; an
archive counts once the job has committed its row in the manifest, so a lost or repeated task leaves
at most files that nobody reads.

Reading: a file at a time, incremental zlib decompression, one record header, then content-length
bytes, hashed as they come; block and payload digests are verified and a mismatch is an error, and so is a
revisit whose digest and length are not those of the response it refers to. Memory
is a few buffers, whatever the record's size (the payload itself is kept only on demand).

The folder may be on any file system that pyarrow opens (file, hdfs, s3, gs).

Edge cases: null html is an empty payload; a null page_id never is the response that others refer to
unless all are null, then all are responses; rows with the same page_id and payload share their type; a null url is
empty; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm._common import materialize, new_scratch, table

URN = "urn:caseloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "!#$&'()*+,/:;=?@[]~-._"
BUFFER = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warcs(pages: DataFrame, folder: str, min_payload: int = 100, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; the manifest (path, records, bytes) of those that count."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    keyed = rows.select("page_id", "digest").where(F.octet_length("html") >= min_payload)
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    big = F.octet_length("html") >= min_payload
    key = F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))
    rows = rows.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left").withColumn("refers_to", F.when(big & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.select("page_id", "url", "html", "digest", "refers_to")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                b = record(page_id, url, text.encode(), digest, refers_to, date)
                out.write(b)
                n, size = n + 1, size + len(b)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


class _Members:
    """Bytes of one gzip member after another from a stream, decompressed as asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.held = stream, b"", None, b""

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(BUFFER)
        self.z, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(BUFFER)
            out, ended = self.z.decompress(self.raw, BUFFER), not self.raw
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
            if ended and not self.z.eof:
                raise ValueError("archive ends inside a record")
        return b""

    def until(self, mark: bytes) -> bytes:
        while mark not in self.held:
            got = self.more()
            if not got:
                raise ValueError("record header does not end")
            self.held += got
        head, _, self.held = self.held.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            part = self.held or self.more()
            if not part:
                raise ValueError("record is shorter than its content-length")
            self.held = part[n:]
            yield part[:n]
            n -= len(part[:n])

    def rest(self) -> bytes:
        out = self.held
        while got := self.more():
            out += got
        return out


def _urn(s: str | None) -> int | None:
    return int(s[len(URN) + 1 : -1]) if s and len(s) > len(URN) + 2 else None


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order; raises ValueError where framing or a digest is wrong."""
    m = _Members(stream)
    while m.next_member():
        lines = m.until(b"\r\n\r\n").decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        if not re.match(r"WARC/1\.[01]$", lines[0]):
            raise ValueError(f"not a record: {lines[0][:40]}")
        block, payload, n, inside, early = hashlib.sha256(), hashlib.sha256(), 0, False, b""
        kept = []
        for part in m.take(int(head["Content-Length"])):
            block.update(part)
            if not inside:
                early += part
                if b"\r\n\r\n" not in early:
                    continue
                inside, part = True, early.partition(b"\r\n\r\n")[2]
            payload.update(part)
            n += len(part)
            if keep_payload:
                kept.append(part)
        if m.rest() != b"\r\n\r\n":
            raise ValueError("record does not end where its content-length says")
        if head["WARC-Block-Digest"] != f"sha256:{block.hexdigest()}":
            raise ValueError(f"block digest of {head['WARC-Record-ID']} is wrong")
        kind, length, digest = head["WARC-Type"], int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and (payload.hexdigest() != digest or n != length):
            raise ValueError(f"payload digest of {head['WARC-Record-ID']} is wrong")
        yield {
            "page_id": _urn(head["WARC-Record-ID"]), "url": unquote(head["WARC-Target-URI"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": _urn(head.get("WARC-Refers-To")), "html": b"".join(kept).decode() if keep_payload and kind == "response" else None,
        }


def read_warcs(manifest: DataFrame, keep_payload: bool = False, batch: int = 256) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html (on demand, responses only)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}

    def rows(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    yield from read_records(stream, keep_payload)

    def run(batches):
        held = []
        for r in rows(batches):
            held.append(r)
            if len(held) == batch:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds.items()], names=list(kinds))
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds.items()], names=list(kinds))

    files = manifest.select("path").repartition(max(1, manifest.count()))  # an archive to a task
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def verify_revisits(records: DataFrame) -> None:
    """Raise ValueError if a revisit refers to no response of its digest and length."""
    has = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    told = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    bad = told.join(has, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"a revisit refers to page {bad[0]['refers_to']}, which has no response of its digest")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warcs(table(spark, sf_dir, "pages"), new_scratch(spark, "warc"))
    records = materialize(read_warcs(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"), "records")
    verify_revisits(records)
    return records


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM p LEFT JOIN f USING (d)
"""
