"""WARC archives: a Python data source that reads them, and a sink that writes them.

Reading (``spark.read.format("warc")``) plans one partition per archive file.
Filters on ``record_type`` and on header columns are pushed into the reader:
each record's header block is parsed first, and the payload of a record that
fails is skipped by its Content-Length, neither decoded nor copied.  If the
query selects no payload (option ``payload`` false) all payloads are skipped.

Writing (``df.write.format("warc")``) takes rows with the columns of
``WRITE_SCHEMA``; each task writes one archive under a temporary name, and
the commit renames the files of successful tasks, so retried or lost tasks
leave no record twice.  Every record is one gzip member.

Files are opened through ``pyarrow.fs``, so any file system that it knows
(local or shared mounts, S3, GCS, HDFS) works.

Defined results: a null payload is written as empty; archives with no records
are valid and read as no rows; a truncated record raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import shared_dir

HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Original-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
READ_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_length bigint, refers_to string, content_length bigint, payload binary"
WRITE_SCHEMA = "page_id bigint, url string, html string, refers_to bigint"
DATE = "2024-01-01T00:00:00Z"  # a fixed capture date keeps archives reproducible


def page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 response or revisit record; a revisit carries no payload."""
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Original-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


class RecordStream:
    """Reads header blocks and payloads of a plain or gzip archive, in order."""

    def __init__(self, raw):
        self.raw, self.held, self.at = raw, b"", 0
        start = raw.read(2)
        self.zip = start == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zip else None
        self.todo = start

    def _more(self) -> bool:
        data = self.todo or self.raw.read(1 << 20)
        self.todo = b""
        if not data:
            return False
        if self.zip:
            out = []
            while data:
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                out.append(self.inflate.decompress(data))
                data = self.inflate.unused_data if self.inflate.eof else b""
            data = b"".join(out)
        self.held = self.held[self.at :] + data
        self.at = 0
        return True

    def headers(self) -> dict[str, str] | None:
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                if self.held[self.at :].strip():
                    raise EOFError("truncated WARC header")
                return None
        lines = self.held[self.at : end].decode("utf-8", "replace").split("\r\n")
        self.at = end + 4
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def body(self, length: int, wanted: bool) -> bytes | None:
        """The payload, or None after skipping it; then the record's end."""
        left, parts = length, []
        while left:
            if self.at == len(self.held) and not self._more():
                raise EOFError("truncated WARC payload")
            step = min(left, len(self.held) - self.at)
            if wanted:
                parts.append(self.held[self.at : self.at + step])
            self.at += step
            left -= step
        while len(self.held) - self.at < 4:
            if not self._more():
                raise EOFError("truncated WARC record")
        self.at += 4
        return b"".join(parts) if wanted else None


@dataclass
class ArchiveFile(InputPartition):
    path: str
    start: int = 0

    def __init__(self, path: str):
        self.path = path


def _filesystem(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Takes equality and membership tests on header columns; returns the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_length":
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.tests.append((f.attribute[0], frozenset(v for v in values if v is not None)))
            else:
                yield f

    def partitions(self):
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
        found = sorted((f.path for f in files if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))))
        prefix = "" if "://" not in self.path or self.path.startswith("file:") else self.path.split("://")[0] + "://"
        return [ArchiveFile(prefix + f) for f in found] or [ArchiveFile("")]

    def read(self, partition):
        if not partition.path:
            return
        system, path = _filesystem(partition.path)
        names = [*HEADERS, "content_length", "payload"]
        schema = pa.schema([(n, pa.int64() if n in ("payload_length", "content_length") else pa.binary() if n == "payload" else pa.string()) for n in names])
        columns: dict[str, list] = {n: [] for n in names}
        size = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(columns[n], schema.field(n).type) for n in names]
            for held in columns.values():
                held.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        with system.open_input_stream(path, compression=None) as raw:
            stream = RecordStream(raw)
            while (head := stream.headers()) is not None:
                found = {k: head.get(v.lower()) for k, v in HEADERS.items()}
                found["payload_length"] = int(found["payload_length"]) if found["payload_length"] else None
                length = int(head["content-length"])
                wanted = all(found[k] in allowed for k, allowed in self.tests)
                payload = stream.body(length, wanted and self.payload)
                if wanted:
                    for n, v in (*found.items(), ("content_length", length), ("payload", payload)):
                        columns[n].append(v)
                    size += length + 512
                    if size > 4 << 20:
                        yield flush()
                        size = 0
        if columns["content_length"]:
            yield flush()


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.level = options["path"], int(options.get("level", "1"))
        if overwrite:
            system, path = _filesystem(self.path)
            system.delete_dir_contents(path, missing_dir_ok=True)

    def write(self, batches):
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/_part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        final = f"{path}/part-{context.partitionId():05d}.warc.gz"
        with system.open_output_stream(name, compression=None) as out:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("page_id", "url", "html", "refers_to")]
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    payload = (html or "").encode()
                    record = record_bytes(page_id, url, payload, sha1_base32(payload), refers_to)
                    squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    out.write(squeeze.compress(record) + squeeze.flush())
        return Written(name, final)

    def commit(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            if m is not None and m.temporary:
                system.move(m.temporary, m.final)

    def abort(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            if m is not None and m.temporary:
                system.delete_file(m.temporary)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the id of the page that holds the same payload, null for responses.

    Only digests are grouped (the maximum combines on the map side); a payload
    that many pages share is one key of a join whose large side can be split.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    heads = pages.where(size >= min_bytes).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = pages.select("page_id", "url", "html").join(heads, digest == heads.digest, "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("head"), F.col("head")).cast("bigint").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record per page: ``pages`` has page_id, url and html; null ids are left out."""
    register(pages.sparkSession)
    rows = plan_revisits(pages.where("page_id is not null"), min_bytes)
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads their records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/graphloom/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
