"""WARC archives as a Python data source.

Writing: each task streams its rows into files of bounded size, one gzip member per record, and names
them in its commit message; the driver writes the names to a list file, and only listed files count,
so lost or repeated tasks leave nothing behind that is read. A member's extra field holds its
compressed length. Reading: files are dealt to partitions by size. Of each record only the header is
inflated first; a record that the pushed predicates reject, or of which no column needs the block, is
skipped by its length. Paths are opened through pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from credsieve.llm.common import ship

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_sha1 string, content_type string, content_length long, http_status int, http_length long, payload binary, file string, offset long"
)
# Names the WARC standard gives to header fields.
FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
    "content_length": "content-length",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FROM_BLOCK = ("http_status", "http_length", "payload")
LIST_PREFIX = "_records-"
FILE_BYTES = 1 << 30
PARTITION_BYTES = 1 << 27
READ_BYTES = 1 << 16
ROWS_OUT = 1000
BYTES_OUT = 1 << 24


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    elif path.startswith("/"):
        path = "file://" + path
    return fs.FileSystem.from_uri(path)


def one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_bytes(row: dict, date: str) -> bytes:
    """A response, or a revisit: its HTTP header with the payload's full length and no payload."""
    payload = row["payload"] or b""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{one_line(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {one_line(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{one_line(row['refers_to'])}>"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + http + payload + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the record's length."""
    squeezer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeezer.compress(record) + squeezer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    lengths = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(lengths)) + lengths
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The compressed length that the extra field of a gzip member names."""
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        size = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"sl" and size == 8:
            return struct.unpack_from("<I", extra, 4)[0]
        extra = extra[4 + size :]
    return None


class Member:
    """Bytes of one record, inflated no further than asked for."""

    def __init__(self, source, at: int):
        self.source, self.at = source, at
        source.seek(at)
        self.raw = source.read(READ_BYTES)
        self.taken = len(self.raw)
        self.gzipped = self.raw[:2] == b"\x1f\x8b"
        self.length = member_length(self.raw) if self.gzipped else None
        self.inflater = zlib.decompressobj(31) if self.gzipped else None
        self.data = bytearray()

    def more(self) -> bool:
        """Get some more of the record; false at its end or the file's."""
        if not self.gzipped:
            self.data += self.raw
            got = len(self.raw)
            self.raw = self.source.read(READ_BYTES)
            self.taken += len(self.raw)
            return bool(got)
        if self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            self.taken += len(self.raw)
        if not self.raw:
            raise EOFError("a record ends before its end")
        self.data += self.inflater.decompress(self.raw, READ_BYTES)
        self.raw = self.inflater.unconsumed_tail
        return True

    def up_to(self, mark: bytes) -> int:
        """Where ``mark`` ends, -1 if nothing is left."""
        seen = 0
        while (found := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark))
            if not self.more():
                if self.data:
                    raise EOFError("a record has no end of header")
                return -1
        return found + len(mark)

    def end(self, size: int) -> int:
        """Where the next record begins, this one having ``size`` bytes."""
        if not self.gzipped:
            return self.at + size
        if self.length is not None:
            return self.at + self.length
        while not self.inflater.eof:
            self.data.clear()
            self.more()
        return self.at + self.taken - len(self.inflater.unused_data)


def header_fields(head: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def header_columns(fields: dict[str, str]) -> dict:
    columns = {c: fields.get(f) for c, f in FIELDS.items()}
    columns["content_length"] = int(columns["content_length"])
    for c in ("record_id", "refers_to"):
        if columns[c]:
            columns[c] = columns[c].removeprefix("<").removesuffix(">")
    kind, _, digest = (columns["payload_digest"] or "").partition(":")
    columns["payload_sha1"] = base64.b32decode(digest).hex() if kind == "sha1" and len(digest) == 32 else None
    return columns


def allows(f: Filter, columns: dict) -> bool:
    value = columns[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualTo):
        return value is not None and value == f.value
    if isinstance(f, In):
        return value is not None and value in f.value
    return value is not None and value.startswith(f.value)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        lists = [i for i in found if i.base_name.startswith(LIST_PREFIX)]
        if lists:
            listed = set()
            for i in lists:
                with system.open_input_stream(i.path) as f:
                    listed |= set(json.loads(f.read()))
            found = [i for i in found if i.base_name in listed]
        else:
            found = [i for i in found if i.base_name.endswith((".warc", ".warc.gz"))]
        parts, held = [Files([])], 0
        for i in sorted(found, key=lambda i: i.base_name):
            if held and held + i.size > self.partition_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(i.path)
            held += i.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        system, _ = file_system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            for row in self.records(system, path):
                rows.append(row)
                held += len(row.get("payload") or b"")
                if len(rows) >= ROWS_OUT or held >= BYTES_OUT:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, system, path: str) -> Iterator[dict]:
        wanted = self.schema.names
        block = any(c in FROM_BLOCK for c in wanted)
        at, size = 0, system.get_file_info(path).size
        with system.open_input_file(path) as source:
            while at < size:
                part = Member(source, at)
                try:
                    head = part.up_to(b"\r\n\r\n")
                    columns = header_columns(header_fields(bytes(part.data[:head])))
                    length = columns["content_length"]
                    if all(allows(f, columns) for f in self.filters):
                        columns |= {"file": path, "offset": at}
                        if block:
                            while len(part.data) < head + length and part.more():
                                pass
                            if len(part.data) < head + length:
                                raise EOFError("its block is cut off")
                            columns |= block_columns(bytes(part.data[head : head + length]), columns["content_type"])
                        yield {c: columns.get(c) for c in wanted}
                    following = part.end(head + length + 4)
                    if following - 4 > size:
                        raise EOFError("the file ends within it")
                    at = following
                except (EOFError, ValueError, TypeError, zlib.error) as e:
                    raise ValueError(f"{path} at byte {at} is not a WARC record: {e}") from e


def block_columns(block: bytes, content_type: str | None) -> dict:
    """The payload is the body of an HTTP block, else the whole block."""
    if not (content_type or "").startswith("application/http"):
        return {"payload": block}
    head, _, body = block.partition(b"\r\n\r\n")
    status = head.split(b"\r\n", 1)[0].split(b" ")
    length = header_fields(head).get("content-length")
    return {
        "payload": body,
        "http_status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None,
        "http_length": int(length) if length and length.isdigit() else None,
    }


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, file_bytes: int, date: str):
        self.path, self.overwrite, self.file_bytes, self.date = path, overwrite, file_bytes, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    row = {c: batch.column(c)[k].as_py() for c in ("record_type", "record_id", "target_uri", "refers_to", "payload")}
                    data = member(record_bytes(row, self.date))
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.startswith(LIST_PREFIX)] if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(f"{path}/{LIST_PREFIX}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(names).encode())
        for p in old:
            system.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                system.delete_file(f"{path}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("warc")``; a read schema that leaves columns out saves their decoding."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        date = self.options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("file_bytes", FILE_BYTES)), date)


def use_warc(spark: SparkSession) -> None:
    """Make the format known to a session, with predicates pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of ``record_type`` (response or revisit), ``record_id``, ``target_uri``,
    ``refers_to`` (a record id, for revisits) and ``payload`` (of revisits too, for their digest).

    A null payload is empty, a null ``target_uri`` is left out. Line breaks in ids and addresses are
    percent-encoded. Other columns are ignored. No rows give an archive without records.
    """
    use_warc(records.sparkSession)
    columns = ["record_type", "record_id", "target_uri", "refers_to", "payload"]
    records.select(*columns).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of a file or folder; only what ``columns`` name is decoded."""
    use_warc(spark)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    chosen = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(chosen).load(path)


ship(__name__)
