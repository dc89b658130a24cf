"""WARC archives: revisit resolution and deduplicated rewriting.

``write_archives`` turns rows into gzip WARC files (one member per record, so a record can
be read on its own) in the shared folder, ``scan_headers`` reads the records of a folder's
files back, without payloads, as rows with file, position, length and digest. Only these headers
are shuffled: by payload digest, to name for each payload the record that stays a response
(the largest id; payloads under ``least`` bytes and records without an id always stay).
``rewrite`` joins the decision to the headers, reads each old record at its place and
writes new archives: responses with their payload, the others as revisit records of the
identical-payload-digest profile (WARC 1.1) with fresh record ids and WARC-Refers-To
headers. Either keeps the other headers that its record had, its date among them; records
of other types (requests, metadata) are copied as they are. Reading those back, a revisit
finds its response through the record id that it refers to.

Files of failed task attempts are never read: each scan is given the list of files that the
finished write returned. A null payload is empty. A null id is written without an id header
and read back as null. Ids may repeat: among equal payloads the largest id stays, and of
rows that share it the last in the archives; the others revisit it. An empty table gives
no archives and an empty result. Other columns are not read, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, shared_fs, written

FILES = "file string, records long"
HEADERS = (
    "file string, position long, size long, record_uuid string, record_type string, id long, uri string, "
    "payload_bytes long, payload_digest string, refers_uuid string, others string"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OWN = ("warc-type", "warc-record-id", "warc-target-uri", "content-type", "content-length", "warc-payload-digest", "x-row-id")
OF_REVISITS = ("warc-profile", "x-payload-length", "warc-refers-to", "warc-refers-to-target-uri", "warc-block-digest", "warc-segment-number")
ROLL = 256 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One compressed WARC record (a gzip member)."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n") + deflate.flush()


def one_line(value: str | None) -> str:
    """A header value: a line break or other control character would end the header."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def other_headers(data: bytes) -> str:
    """The header lines that ``rewrite`` doesn't write itself, as they stand."""
    lines = data.partition(b"\r\n\r\n")[0].decode("utf-8").split("\r\n")[1:]
    return "\r\n".join(x for x in lines if x.partition(":")[0].strip().lower() not in OWN + OF_REVISITS)


def header_pairs(lines: str) -> list[tuple[str, str]]:
    return [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines.split("\r\n") if x)]


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[: int(headers["content-length"])]


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


class Archives:
    """A task's archive files: a new one after ``ROLL`` bytes."""

    def __init__(self, folder: str):
        self.folder, self.file, self.done = folder, None, []

    def add(self, record: bytes) -> None:
        if self.file is None:
            fs, root = shared_fs(self.folder)
            fs.create_dir(root, recursive=True)
            self.name, self.records, self.bytes = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.file = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.file.write(record)
        self.records += 1
        self.bytes += len(record)
        if self.bytes >= ROLL:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((f"{self.folder}/{self.name}", self.records))
            self.file = None

    def rows(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in self.done], pa.string()), pa.array([x[1] for x in self.done], pa.int64())], names=["file", "records"])


def write_archives(rows: DataFrame, folder: str, id_col: str, uri: str, payload: str, date: str | None = None) -> DataFrame:
    """One response record per row, dated ``date`` (by default now); the files written."""
    date = date or now()

    def write(batches):
        out = Archives(folder)
        for b in batches:
            for k, u, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body = (text or "").encode("utf-8", "surrogatepass")
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", one_line(u)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(body))]
                if k is not None:
                    headers.append(("X-Row-ID", str(k)))
                out.add(record_bytes(headers, http_block(body)))
        yield out.rows()

    return written(rows.select(F.col(id_col).cast("long"), F.col(uri).cast("string"), F.col(payload).cast("string")).mapInArrow(write, FILES), "warc-files")


def records_of(file: str):
    """(position, size, headers, block, other headers) of each record of an archive, read as a stream."""
    fs, path = shared_fs(file)
    with fs.open_input_stream(path, compression=None) as f:
        position, pending = 0, b""
        while True:
            inflate, size, parts = zlib.decompressobj(31), 0, []
            while not inflate.eof:
                if not pending:
                    pending = f.read(1 << 20)
                    if not pending:
                        if size:
                            raise ValueError(f"{file} ends inside a record at {position}")
                        return
                parts.append(inflate.decompress(pending))
                size += len(pending) - len(inflate.unused_data)
                pending = inflate.unused_data
            data = b"".join(parts)
            yield position, size, *parse_record(data), other_headers(data)
            position += size


def scan_headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row of headers for every record of the files."""
    names = [x.split()[0] for x in HEADERS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in HEADERS.split(", ")]

    def scan(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                for position, size, h, block, others in records_of(file):
                    k, d = h.get("x-row-id"), h.get("warc-payload-digest", "")
                    if h["warc-type"] == "revisit":
                        n = int(h["x-payload-length"]) if "x-payload-length" in h else None
                    elif h["warc-type"] != "response":
                        n, d = None, ""
                    else:
                        body = block.partition(b"\r\n\r\n")[2]
                        n, d = len(body), "sha1:" + digest(body)
                    rows.append((file, position, size, h["warc-record-id"], h["warc-type"], None if k is None else int(k), h.get("warc-target-uri"), n, d.removeprefix("sha1:"), h.get("warc-refers-to"), others))
                    if len(rows) == 10_000:
                        yield _batch(rows, names, types)
                        rows = []
                if rows:
                    yield _batch(rows, names, types)

    return _spread(files).mapInArrow(scan, HEADERS)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def _spread(files: DataFrame) -> DataFrame:
    """One short row per archive, dealt evenly: a task reads one archive or two."""
    return files.select("file").repartition(max(1, files.count()))


def revisit_decisions(headers: DataFrame, least: int = 0) -> DataFrame:
    """The headers with ``keep_uuid``: the record that a record revisits, null for those
    that stay what they are. Headers are grouped by digest with partial maxima; revisits that the
    archives already hold are pointed at the response that stays, if there is one."""
    h = headers.where("payload_digest <> '' AND record_type IN ('response', 'revisit')")
    able = h.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least) & F.col("id").isNotNull())
    # Of rows that share the largest id the last in the archives: one struct to order by.
    best = able.groupBy("payload_digest").agg(
        F.max("id").alias("id"), F.max_by(F.struct("record_uuid", "uri"), F.struct(F.col("id"), "file", "position")).alias("at")
    )
    keep = written(best.select(F.col("payload_digest").alias("keep_digest"), F.col("id").alias("keep_id"), F.col("at.record_uuid").alias("keep_uuid"), F.col("at.uri").alias("keep_uri")), "warc-originals")
    on = headers["payload_digest"] == keep["keep_digest"]
    stays = (F.col("record_uuid") == F.col("keep_uuid")) | ((F.col("record_type") == "response") & ((F.col("payload_bytes") < least) | F.col("id").isNull()))
    joined = headers.join(keep, on, "left")
    return joined.select(*headers.columns, *[F.when(stays, None).otherwise(F.col(c)).alias(c) for c in ("keep_uuid", "keep_uri")])


def rewrite(decided: DataFrame, folder: str) -> DataFrame:
    """Write deduplicated archives; returns their files. Old records are read at their place,
    sorted by file and position so that each archive is read once, forwards."""

    def write(batches):
        out, at, f = Archives(folder), None, None
        for b in batches:
            for r in b.to_pylist():
                if r["keep_uuid"] is None:
                    if at != r["file"]:
                        fs, path = shared_fs(r["file"])
                        at, f = r["file"], fs.open_input_file(path)
                    f.seek(r["position"])
                    data = f.read(r["size"])
                    if r["record_type"] not in ("response", "revisit"):
                        out.add(data)
                        continue
                    old, block = parse_record(zlib.decompress(data, 31))
                else:
                    old, block = {}, b"HTTP/1.1 200 OK\r\n\r\n"
                kind = r["record_type"] if r["keep_uuid"] is None else "revisit"
                # The record that stays keeps its name: others refer to it by it.
                name = r["record_uuid"] if kind == "response" else f"<urn:uuid:{uuid.uuid4()}>"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Target-URI", r["uri"] or ""), ("Content-Type", old.get("content-type", "application/http; msgtype=response")), ("WARC-Payload-Digest", "sha1:" + r["payload_digest"])]
                headers += header_pairs(r["others"])
                if r["id"] is not None:
                    headers.append(("X-Row-ID", str(r["id"])))
                if kind == "revisit":
                    headers += [("WARC-Profile", PROFILE)]
                    headers += [("X-Payload-Length", str(r["payload_bytes"]))] if r["payload_bytes"] is not None else []
                    target = r["keep_uuid"] or r["refers_uuid"]
                    headers += [("WARC-Refers-To", target)] if target else []
                    headers += [("WARC-Refers-To-Target-URI", r["keep_uri"])] if r["keep_uri"] else []
                out.add(record_bytes(headers, block))
        yield out.rows()

    dealt = decided.repartition("file", F.floor(F.col("position") / (64 << 20))).sortWithinPartitions("file", "position")
    return written(dealt.mapInArrow(write, FILES), "warc-files")


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to): each revisit joined to
    the response whose record id it refers to."""
    h = written(headers, "warc-headers")
    names = written(h.where("record_type = 'response'").select(F.col("record_uuid").alias("name"), F.col("id").alias("refers_to")), "warc-names")
    plain = h.where("record_type <> 'revisit' OR refers_uuid IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    # The response names the join's other side once each; a response with many revisits is a skewed join.
    back = h.where("record_type = 'revisit' AND refers_uuid IS NOT NULL").join(names, F.col("refers_uuid") == F.col("name"), "left")
    columns = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(columns).union(back.select(columns))


def deduplicate(rows: DataFrame, id_col: str, uri: str, payload: str, least: int = 0, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Archive the rows, write deduplicated archives, read them back: (files, records)."""
    spark = rows.sparkSession
    first = write_archives(rows, scratch_path(spark, "warc"), id_col, uri, payload, date)
    headers = written(scan_headers(spark, first), "warc-headers")
    files = rewrite(revisit_decisions(headers, least), scratch_path(spark, "warc-deduplicated"))
    return files, resolve_revisits(scan_headers(spark, files))
