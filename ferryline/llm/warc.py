"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own.  A reading task gets a byte range of an archive: it scans the
range for gzip magic, takes a candidate member only if its decoded start is a WARC header, and owns the
records that start inside its range, reading past the end to finish the last one.  From a member that it
owns, it goes on to the next at the exact place where the first ended.

Archives lie in the folder of spark.checkpoint.dir (or one that is given) and are opened by its URI through
pyarrow's file systems (file, hdfs, s3, ...).  A task writes under a name of its attempt and renames at the
end, so lost executors and repeated tasks leave whole files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, raw, shared_path

SPLIT = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_URN = "urn:ferryline:page:"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: bytes) -> bytes:
    """A URL fit for a header line: control characters and spaces are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)


def record(page_id: int | None, url: bytes | None, payload: bytes, refers_to: int | None, date: str, row: str) -> bytes:
    """One record: a response, or a revisit without the payload if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "none:" + row if page_id is None else str(page_id)
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}".encode(),
        f"WARC-Record-ID: <{_URN}{name}>".encode(),
        f"WARC-Date: {date}".encode(),
        f"WARC-Payload-Digest: sha1:{_digest(payload)}".encode(),
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.insert(1, b"WARC-Target-URI: " + _uri(url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return b"WARC/1.1\r\n" + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(folder: str, date: str):
    def run(batches):
        at, out, size, n, stream = TaskContext.get(), None, 0, 0, None
        part = at.partitionId()
        for b in batches:
            for i, url, html, ref in zip(b.column("id").to_pylist(), raw(b.column("url")), raw(b.column("html")), b.column("refers_to").to_pylist()):
                if out is None:
                    store, root = pafs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    temp = f"{root}/.part-{part:06d}-{at.taskAttemptId()}"
                    stream = store.open_output_stream(temp, compression=None)
                    out = f"part-{part:06d}.warc.gz"
                    info = b"software: ferryline\r\n"
                    size += stream.write(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:ferryline:file:%d>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (part, date.encode(), len(info), info)))
                size += stream.write(member(record(i, url, html or b"", ref, date, f"{part}:{n}")))
                n += 1
        if out is not None:
            stream.close()
            store.move(temp, f"{root}/{out}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{out}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write one record per row; returns (path, size, records), a row per archive.

    Of rows with equal payloads (the HTML in UTF-8; null is empty) of at least ``least_bytes`` bytes, that with
    the smallest id becomes a response and the others revisits of it; every other row is a response.  Rows that
    share that smallest id are all responses.  A row with a null id is a revisit if a row with an id has its
    payload, and a response otherwise.  An empty table writes nothing; other columns are not read.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    folder = folder or shared_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256))
    light = rows.filter(F.octet_length("html") >= least_bytes).select("id", "key")
    firsts = checkpointed(light.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("key", "first"))
    again = light.join(firsts, "key").filter(F.col("id").isNull() | (F.col("id") != F.col("first"))).distinct()
    again = again.select(F.col("id").alias("again_id"), F.col("key").alias("again_key"), "first")
    joined = rows.join(again, (F.col("key") == F.col("again_key")) & F.col("id").eqNullSafe(F.col("again_id")), "left")
    return checkpointed(joined.select("id", "url", "html", F.col("first").alias("refers_to")).mapInArrow(_write(folder, date), "path string, size bigint, records bigint"))


class _Range:
    """Bytes of a file from ``start`` on, read as far as they are asked for."""

    def __init__(self, file, start: int, size: int, step: int = 1 << 20):
        self.file, self.at, self.size, self.step, self.data = file, start, size, step, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(min(self.step, self.size - self.at - len(self.data)))
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def members(file, start: int, end: int, size: int):
    """(offset, bytes) of the gzip members that start in [start, end) and decode to a WARC header."""
    r = _Range(file, start, size)
    while r.at < end:
        i = r.data.find(_MAGIC)
        if i < 0:
            r.drop(max(0, len(r.data) - 2))
            if not r.more():
                return
            continue
        r.drop(i)
        if r.at >= end:
            return
        offset, d, out, fed = r.at, zlib.decompressobj(31), [], 0
        known = False
        try:
            while not d.eof:
                if fed == len(r.data) and not r.more():
                    raise zlib.error("cut off")
                piece = r.data[fed : fed + 65536]
                fed += len(piece)
                out.append(d.decompress(piece))
                if not known and sum(map(len, out)) >= 7:
                    known = b"".join(out)[:7] == b"WARC/1."
                    if not known:
                        raise zlib.error("no WARC header")
            if not known:
                raise zlib.error("no WARC header")
        except zlib.error:
            r.drop(1)  # magic by chance
            continue
        r.drop(fed - len(d.unused_data))
        yield offset, b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name (the version under the empty name), and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    fields[""] = lines[0]
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str | None) -> int | None:
    got = re.fullmatch(rf"<{_URN}(-?\d+)>", urn or "")
    return int(got[1]) if got else None


_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_DDL = "path string, offset bigint, record_type string, page_id bigint, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"


def _read(with_payload: bool):
    def run(batches):
        schema = pa.schema(_FIELDS)
        for b in batches:
            for path, start, end, size in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end", "size"))):
                store, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, data in members(file, start, end, size):
                        fields, block = parsed(data)
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            length = len(payload)
                            if _digest(payload) != digest:
                                raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                        else:
                            length = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                        rows.append((path, offset, kind, _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), length, digest, payload if with_payload and kind == "response" else None))
                        held += len(payload) if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], schema=schema)

    return run


def read_warc(archives: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of ``archives`` (path, size), read in byte ranges of ``split`` bytes.

    One row per record: path, offset, record_type, page_id (null for a record that has none), refers_to, url,
    payload_bytes, payload_digest (base32 SHA-1) and payload (null for revisits, or without ``with_payload``).
    Payloads are checked against their digests.  No archives give no rows.
    """
    parts = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("start"))
    parts = parts.withColumn("end", F.least(F.col("start") + split, F.col("size")))
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "path", "start").mapInArrow(_read(with_payload), _DDL)


def op7_query(spark, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_warc(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
x AS (SELECT p.page_id, p.h, first_id, sha1(p.h) AS hex FROM p JOIN f USING (h)),
v AS (SELECT page_id, h, first_id, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::INTEGER) AS q FROM x)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(q, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v
"""
