"""WARC archives as a Python data source (``format("warc")``), with revisit records.

Every record is a gzip member of its own whose header states the member's
compressed length (the WARC standard's skip-length field), so any gzip reader
opens the archives and ours passes over a member without inflating it.

Reading plans one partition per archive file, takes record-type and header
predicates by filter pushdown, inflates and parses the headers of a record first
and seeks past the payloads of records that are not wanted.  Writing goes through
the same source: every task writes its own files, and the driver's commit lists
the files of the successful attempts, so retried tasks leave nothing that is read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    IsNotNull, WriterCommitMessage)

SCHEMA = ("record_type string, record_id string, target_uri string, page_id long, refers_to long, "
          "payload_digest string, payload_length long, payload binary")
WRITE = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_length long, payload binary"
#: A file is closed once it holds this many bytes; it is the unit of reading.
FILE_BYTES = 64 << 20
#: Payloads below this size are always full responses.
MIN_REVISIT_BYTES = 1000
FILTERED = ("record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest", "payload_length")
_MANIFEST = "_manifest.json"


#: Schemes that Python workers reach (hdfs needs libhdfs on every one), and Hadoop's names for them.
SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")
HADOOP_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _uri(path: str) -> str:
    """``path`` as the workers' file systems name it; an error lists the schemes if its own is none of them."""
    scheme, colon, rest = path.partition(":")
    if not colon or not ("://" in path or scheme == "file"):
        return os.path.abspath(path)
    scheme = HADOOP_SCHEMES.get(scheme, scheme)
    if scheme not in SCHEMES:
        raise ValueError(f"archives cannot be kept at {path!r}: the scheme must be one of {', '.join((*SCHEMES, *HADOOP_SCHEMES))}")
    return f"{scheme}:{rest}"


def _filesystem(path: str):
    return fs.FileSystem.from_uri(_uri(path))


def _line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None):
    digits = (urn or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def record_bytes(row) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (with the full length) and drops the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_length}\r\n\r\n").encode()
    body = http if row.record_type == "revisit" else http + bytes(row.payload)
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {_urn(row.page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row.payload_digest}"]
    if row.url is not None:
        head.append(f"WARC-Target-URI: {_line(row.url)}")
    if row.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(row.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


#: Fixed part of a gzip header with one extra field "sl": compressed and full length of the member.
_GZIP = struct.Struct("<4sIBBH2sHII")


def member(record: bytes) -> bytes:
    """``record`` as one gzip member with its skip length."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = pack.compress(record) + pack.flush()
    total = _GZIP.size + len(body) + 8
    full = len(record) & 0xFFFFFFFF
    head = _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, total, full)
    return head + body + struct.pack("<II", zlib.crc32(record), full)


class _Member:
    """Reads one member from its start, inflating no more than was asked for."""

    STEP = 4096

    def __init__(self, f, at: int) -> None:
        f.seek(at)
        head = f.read(_GZIP.size)
        if len(head) < _GZIP.size or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no gzip member with an extra field at byte {at}")
        *_, tag, _, length, full = _GZIP.unpack(head)
        if tag != b"sl":
            raise ValueError(f"the member at byte {at} states no skip length")
        self.end, self._f, self._full = at + length, f, full
        self._left = length - _GZIP.size - 8
        self._pack, self._raw, self._at = zlib.decompressobj(-zlib.MAX_WBITS), b"", 0

    def _more(self, step: int) -> bool:
        if self._pack.unconsumed_tail:
            source = self._pack.unconsumed_tail
        else:
            source = self._f.read(min(step, self._left))
            self._left -= len(source)
        got = self._pack.decompress(source, step)
        self._raw += got
        return bool(got or source)

    def header(self) -> dict[str, str]:
        """The fields (lower-case names) of the header that comes next."""
        while (end := self._raw.find(b"\r\n\r\n", self._at)) < 0:
            if not self._more(self.STEP):
                raise ValueError("a record ends inside its header")
        fields = {}
        for line in self._raw[self._at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        self._at = end + 4
        return fields

    def body(self, n: int) -> bytes:
        """The next ``n`` bytes; a damaged member raises an error."""
        rest = [self._raw]
        if self._pack.unconsumed_tail:
            rest.append(self._pack.decompress(self._pack.unconsumed_tail))
        rest += [self._pack.decompress(self._f.read(self._left)), self._pack.flush()]
        whole = b"".join(rest)
        crc, full = struct.unpack("<II", self._f.read(8))
        if zlib.crc32(whole) != crc or len(whole) & 0xFFFFFFFF != full:
            raise ValueError("the record does not match its checksum")
        return whole[self._at:self._at + n]


class _Files(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows):
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for row in rows:
            if out is None or size >= FILE_BYTES:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            size += out.write(member(record_bytes(row)))
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages) -> None:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_MANIFEST}") as out:
            out.write(json.dumps({"files": sorted(n for m in messages if m is not None for n in m.names),
                                  "written": datetime.now(timezone.utc).isoformat()}).encode())


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FILTERED and isinstance(f, EqualTo):
                self.wanted.append((name, (f.value,)))
            elif name in FILTERED and isinstance(f, In):
                self.wanted.append((name, tuple(f.value)))
            elif name in FILTERED and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self):
        store, root = _filesystem(self.path)
        with store.open_input_stream(f"{root}/{_MANIFEST}") as f:
            return [_File(n) for n in json.loads(f.read())["files"]] or [_File("")]

    def read(self, partition):
        if not partition.name:
            return
        store, root = _filesystem(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            at, total = 0, f.size()
            while at < total:
                record = _Member(f, at)
                at = record.end
                head = record.header()
                row = {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"),
                       "target_uri": head.get("warc-target-uri"), "page_id": _page(head.get("warc-record-id")),
                       "refers_to": _page(head.get("warc-refers-to")),
                       "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:")}
                if not self._keeps(row):
                    continue  # the rest of the member is never read
                n = int(record.header()["content-length"])
                row["payload_length"] = n
                if not self._keeps(row):
                    continue
                payload = record.body(n) if self.payload and row["record_type"] != "revisit" else None
                yield (*(row[c] for c in FILTERED), payload)

    def _keeps(self, row: dict) -> bool:
        return all(name not in row or (row[name] is not None if values is None else row[name] in values)
                   for name, values in self.wanted)


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (``false`` reads headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_record_types(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as the writer's rows.

    A null html is an empty payload.  Of equal payloads of at least 1000 bytes
    the one with the largest page_id is the response and the others revisit it;
    should rows repeat that page_id, all of them are responses.  A null page_id
    sorts before every other.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    last = (rows.where(F.col("payload_length") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
            .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL"))
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return (rows.join(last, "payload_digest", "left")
            .select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("last")).alias("refers_to"), "payload_digest", "payload_length",
                    F.when(~revisit, F.col("payload")).alias("payload")))


def write_archives(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    with_record_types(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last <> p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
