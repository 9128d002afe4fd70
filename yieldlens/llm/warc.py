"""WARC as a Python data source: batch writer and reader.

Writing: each task writes archives of at most ``maxfilebytes`` (raw bytes), one gzip member
per record, whose header carries the member's length (the "sl" extra field), so a reader can
jump over a record it does not want. A manifest written at commit names the files of
finished tasks; files of lost or repeated attempts are never read.

Reading: the driver plans partitions of whole files of about ``partitionbytes``. Filters on
record_type, target_uri, record_id and page_id are pushed down: a record's headers are parsed
first and its payload is inflated only when the headers pass and ``payload`` is asked for
(option ``payload`` = "false" leaves payloads null and unread). Members without the length
field, as other tools write them, are read through.

Duplicate payloads: a revisit record holds the response headers only; its Content-Length and
WARC-Payload-Digest are those of the full payload, and WARC-Refers-To names the response.

Edge cases: a null html is an empty payload; a null url is written without a target URI; of
equal payloads of at least ``least`` bytes the largest page_id is the response (null page_ids
are smallest, rows that repeat it are all responses, and a null page_id refers and is referred
to as null); a manifest of no files reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from ..session import table
from .common import shared_path

SCHEMA = "page_id bigint, record_id string, record_type string, target_uri string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
DATE = "2000-01-01T00:00:00Z"
PUSHABLE = ("record_type", "target_uri", "record_id", "page_id")


def _store(path: str):
    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str | None) -> int | None:
    """The page of a record id written here; None for ids of other tools."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", rid or "")
    return int(found[1]) if found else None


def digest_of(value: str | None) -> str | None:
    """Hex SHA-1 of a digest header in base 32 or hex; None for other or broken ones."""
    algo, _, text = (value or "").partition(":")
    text = text.strip()
    if algo.strip().lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", text):
        return text.lower()
    try:
        return base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


# ---------------------------------------------------------------- records


def pack_record(page_id, url, kind: str, refers_to, payload: bytes, size: int, digest: str, level: int = 1) -> bytes:
    """One gzip member: WARC headers, HTTP headers, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


class Member:
    """A gzip member of a stream, inflated only as far as asked for."""

    def __init__(self, stream, held: bytes):
        self.stream, self.data = stream, held
        head = self._fill(12)
        self.length = None
        if head[3] & 4:
            stop = 12 + struct.unpack("<H", head[10:12])[0]
            extra = self._fill(stop)[12:stop]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        self.inflate = zlib.decompressobj(31)
        self.fed, self.out = 0, b""

    def _fill(self, n: int) -> bytes:
        while len(self.data) < n and (more := self.stream.read(max(n - len(self.data), 1 << 16))):
            self.data += more
        return self.data

    def _step(self, limit: int) -> bool:
        """Inflate some more; False at the end of the member."""
        if self.inflate.eof:
            return False
        feed = self.inflate.unconsumed_tail
        if not feed:
            self._fill(self.fed + 1)
            feed = self.data[self.fed : self.fed + (1 << 16)]
            self.fed += len(feed)
        if not feed:
            raise EOFError("truncated record")
        self.out += self.inflate.decompress(feed, limit)
        return True

    def upto(self, mark: bytes, start: int = 0) -> int:
        """Position after ``mark``."""
        while (at := self.out.find(mark, start)) < 0:
            if not self._step(1024):
                raise ValueError("record without headers")
        return at + len(mark)

    def first(self, n: int) -> bytes:
        while len(self.out) < n and self._step(n - len(self.out)):
            pass
        return self.out[:n]

    def rest(self) -> bytes:
        """Bytes of the stream after the member, reading no payload if its length is known."""
        if self.length is not None:
            if self.length <= len(self.data):
                return self.data[self.length :]
            gap = self.length - len(self.data)
            while gap and (got := self.stream.read(min(gap, 1 << 20))):
                gap -= len(got)
            return b""
        while self._step(1 << 20):
            self.out = b""
        return self.inflate.unused_data + self.data[self.fed :]


def read_records(stream, passes, want_payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose headers pass."""
    held = b""
    while held or (held := stream.read(1 << 16)):
        m = Member(stream, held)
        end = m.upto(b"\r\n\r\n")
        h = _headers(m.out[: end - 4])
        rid, kind, uri = h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri")
        page = page_of(rid)
        if passes({"record_type": kind, "target_uri": uri, "record_id": rid, "page_id": page}):
            size, payload, digest = None, None, digest_of(h.get("warc-payload-digest"))
            if kind in ("response", "revisit"):
                stop = end + int(h.get("content-length") or 0)
                begin, http = end, {}
                if h.get("content-type", "application/http").startswith("application/http") and stop > end:
                    begin = m.upto(b"\r\n\r\n", end)
                    http = _headers(m.out[end : begin - 4])
                if kind == "response":  # its bytes are there, whatever the HTTP headers say
                    size = max(stop - begin, 0)
                    if want_payload:
                        payload = m.first(stop)[begin:stop]
                        digest = digest or hashlib.sha1(payload).hexdigest()
                elif (http.get("content-length") or "").isdigit():
                    size = int(http["content-length"])
            yield page, rid, kind, uri, page_of(h.get("warc-refers-to")), size, digest, payload
        held = m.rest()


# ---------------------------------------------------------------- data source


@dataclass
class Files(InputPartition):
    paths: tuple


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = options, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In, StringStartsWith)) and column in PUSHABLE:
                self.filters.append((column, "starts" if isinstance(f, StringStartsWith) else "in", f.value if isinstance(f, (In, StringStartsWith)) else (f.value,)))
            else:
                yield f

    def partitions(self):
        limit = int(self.options.get("partitionbytes", 32 << 20))
        store, root = _store(self.options["path"])
        if store.get_file_info(f"{root}/_manifest.json").type == fs.FileType.NotFound:
            # a folder of another tool's archives
            found = store.get_file_info(fs.FileSelector(root))
            files = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".warc.gz"))
        else:
            with store.open_input_stream(f"{root}/_manifest.json") as f:
                files = json.loads(f.read())
        parts, now, size = [], [], 0
        for name, n in files:
            if now and size + n > limit:
                parts.append(Files(tuple(now)))
                now, size = [], 0
            now.append(name)
            size += n
        return [*parts, Files(tuple(now))]

    def read(self, partition):
        store, root = _store(self.options["path"])
        filters = self.filters

        def passes(h: dict) -> bool:
            for column, kind, value in filters:
                got = h[column]
                if got is None or (not got.startswith(value) if kind == "starts" else got not in value):
                    return False
            return True

        want = self.options.get("payload", "true") != "false"
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for name in partition.paths:
            with store.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as stream:
                rows, size = [], 0
                for row in read_records(stream, passes, want):
                    rows.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options
        store, root = _store(options["path"])
        store.create_dir(root, recursive=True)

    def write(self, iterator):
        limit, level = int(self.options.get("maxfilebytes", 64 << 20)), int(self.options.get("level", 1))
        store, root = _store(self.options["path"])
        files, out, name, raw, packed = [], None, "", 0, 0
        for b in iterator:
            cols = {c: b.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")}
            for page, url, kind, refers, payload, size, digest in zip(*cols.values(), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, raw, packed = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                record = pack_record(page, url, kind, refers, payload or b"", size, digest, level)
                out.write(record)
                raw, packed = raw + len(payload or b""), packed + len(record)
                if raw >= limit:
                    out.close()
                    files.append((name, packed))
                    out = None
        if out is not None:
            out.close()
            files.append((name, packed))
        return Written(files)

    def commit(self, messages):
        store, root = _store(self.options["path"])
        with store.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        """Nothing to undo: without a manifest the files are not read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


# ---------------------------------------------------------------- jobs


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, least: int = 1000) -> DataFrame:
    """WARC rows of ``pages`` (page_id, url, html): of equal payloads of ``least`` bytes or more the
    largest page_id is the response and the others revisit it."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    many = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", "last")
    # smaller payloads have no partner: a key of their own keeps a million empty pages from one task
    alone = F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))
    base = base.withColumn("partner", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(alone))
    base = base.join(many.withColumnRenamed("payload_digest", "partner"), "partner", "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.col("payload_bytes") >= least)
    return base.select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("last")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
    )


def write_warc(records: DataFrame, path: str, **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(path=path, **{k: str(v) for k, v in options.items()}).save()


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archives back: responses with their payload, whose size
    and digest are taken anew from its bytes, and revisits from their headers."""
    path = shared_path(spark, "warc")
    write_warc(records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    full = read_warc(spark, path).where(F.col("record_type") == "response")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    thin = read_warc(spark, path, payload="false").where(F.col("record_type") == "revisit")
    return full.unionByName(thin.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN m.last IS NOT NULL AND p.payload_bytes >= 1000 AND p.page_id IS DISTINCT FROM m.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= 1000 AND p.page_id IS DISTINCT FROM m.last THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest
"""
