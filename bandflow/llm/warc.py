"""WARC archives as a PySpark Python data source, read and written.

`spark.read.format("warc").load(folder)` plans one partition for each stretch
of a committed file. Record-type and header predicates are pushed down: a
record's headers are parsed first, and the payload of an unwanted record is
stepped over, neither read nor decoded. `option("payload", "false")` steps
over every payload; `option("verify", "true")` reads each response's payload
to compare its digest. Writing goes through a commit: a task's files count
only when its message reaches the driver's manifest, so attempts that are lost
or run twice leave nothing that a reader would see.

Defined results: a null payload is the empty one; a null page id or URL gives
an empty header value and is read back as null; control characters in a URL
are percent-encoded; rows that tie on payload and page id are all responses;
an empty table gives an archive without records; extra columns are not
archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, shared_dir, table

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, digest_ok boolean, payload binary"
MANIFEST = "_manifest.json"
# Names that the WARC standard gives.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
#: An extension field: the length of the full payload, also where a revisit leaves it out.
LENGTH = "X-Payload-Length"
#: A committed file is cut into read partitions of about this many bytes.
STRETCH = 32 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def clean(value: str | None) -> str:
    return "" if value is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), (LENGTH, str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (record_type, record_id, target_uri, refers_to, payload)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.packed = options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.path)
        out, name, size, marks, rows = None, f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed, 0, [0], 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload")]
            for i in range(batch.num_rows):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                kind, record_id, uri, refers_to, payload = (c[i].as_py() for c in columns)
                data = record(kind, clean(record_id), clean(uri), refers_to, payload or b"")
                data = gzip.compress(data, 1) if self.packed else data
                if size - marks[-1] >= STRETCH:
                    marks.append(size)
                out.write(data)
                size, rows = size + len(data), rows + 1
        if out is None:
            return Written([])
        out.close()
        return Written([{"name": name, "bytes": size, "marks": marks, "rows": rows}])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if not self.overwrite:
            files = manifest(self.path) + files
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        for f in [f for m in messages if m for f in m.files]:
            system.delete_file(f"{root}/{f['name']}")


def manifest(path: str) -> list[dict]:
    """The committed files of a folder."""
    system, root = place(path.rstrip("/"))
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Stretch(InputPartition):
    name: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.verify = options.get("verify", "false").lower() == "true"
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Takes equality and membership on header columns; hands the rest back."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in HEADER_OF:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name == "record_type"):
                yield f

    def partitions(self):
        out = []
        for f in manifest(self.path):
            out += [Stretch(f["name"], a, b) for a, b in zip(f["marks"], [*f["marks"][1:], f["bytes"]], strict=True)]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in self.records(partition):
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def records(self, part: Stretch) -> Iterator[tuple]:
        if not part.name:
            return
        system, root = place(self.path)
        with system.open_input_file(f"{root}/{part.name}") as raw:
            packed = part.name.endswith(".gz")
            if packed:
                raw.seek(part.start)
                source = gzip.GzipFile(fileobj=io.BytesIO(raw.read(part.end - part.start)))
            else:
                source = io.BufferedReader(Window(raw, part.start, part.end), 1 << 16)
            while head := read_head(source):
                length = int(head["content-length"])
                if not self.accepts(head):
                    source.seek(length + 4, io.SEEK_CUR)
                    continue
                kind, payload, ok = head["warc-type"], None, None
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "response" and (self.payload or self.verify):
                    block = source.read(length)
                    source.seek(4, io.SEEK_CUR)
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if self.verify:
                        ok = base32_sha1(payload) == digest and len(payload) == int(head.get(LENGTH.lower(), len(payload)))
                    payload = payload if self.payload else None
                else:
                    source.seek(length + 4, io.SEEK_CUR)
                known = head.get(LENGTH.lower())
                yield kind, bare(head.get("warc-record-id")), head.get("warc-target-uri") or None, bare(head.get("warc-refers-to")), digest, int(known) if known else None, ok, payload

    def accepts(self, head: dict[str, str]) -> bool:
        for name, values in self.wanted.items():
            value = head.get(HEADER_OF[name].lower())
            value = bare(value) if name in ("record_id", "refers_to") else value and value.removeprefix("sha1:")
            if (value or None) not in values:  # an empty header reads as null
                return False
        return True


class Window(io.RawIOBase):
    """Bytes start..end of a random-access file."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end = file, start, end
        self.file.seek(start)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(min(len(into), self.end - self.file.tell()))
        into[: len(data)] = data
        return len(data)

    def tell(self) -> int:
        return self.file.tell() - self.start

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = {io.SEEK_SET: self.start, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.end}[whence] + offset
        self.file.seek(min(to, self.end))
        return self.tell()


def read_head(source) -> dict[str, str] | None:
    """The next record's headers by lower-case name; None at the end."""
    first = source.readline()
    if not first:
        return None
    if first.rstrip() not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    head = {}
    while (line := source.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


def bare(value: str | None) -> str | None:
    return value.strip("<>") or None if value else None


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Repeated payloads known by at most this many digests are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_DIGESTS = 50_000


def planned(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Records of `pages(page_id, url, html)`: of equal payloads of at least
    `min_revisit_bytes` bytes the one with the largest page id is the
    response and the others revisit it."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest, size = F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")
    repeated = rows.select("page_id", digest, size).where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated)
    few = repeated.count() <= BROADCAST_DIGESTS
    rows = rows.select("*", digest, size).join(F.broadcast(repeated) if few else repeated, ["digest", "size"], "left")
    older = F.col("page_id").isNull() & F.col("newest").isNotNull() | (F.col("page_id") < F.col("newest"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        F.when(older, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(older, name("newest")).alias("refers_to"),
        "payload",
    )


def archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, compression: str = "none") -> None:
    """Writes a record for every page into WARC files below `path`."""
    register(pages.sparkSession)
    planned(pages, min_revisit_bytes).write.format("warc").mode("append").option("compression", compression).save(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back: payload size and digest, record type and what it revisits."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(table(spark, sf_dir, "pages"), path)
    back = spark.read.format("warc").option("payload", "false").option("verify", "true").load(path)
    page = lambda c: F.when(F.length(F.substring(c, 10, 20)) > 0, F.substring(c, 10, 20).cast("long"))
    return back.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
        "digest_ok",
    )
