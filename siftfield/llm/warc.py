"""WARC archives as a Spark data source, in both directions.

Reading: one task per group of files; filters on the record type and on header fields are pushed down
and decided on a record's headers, before its block is decoded.  Every record of a ``.warc.gz`` is a
gzip member of its own; members written here carry their length in a gzip extra field, so a record
that isn't wanted is stepped over without being decompressed.  Other members are decompressed to find
their end, bit by bit and without keeping what isn't wanted; uncompressed records are stepped over by their Content-Length.

Writing: each task writes files of bounded size to a temporary folder of its own, and the commit moves those
of the successful attempts into place, so lost executors and repeated tasks leave nothing half-written.

Paths may be anything that ``pyarrow.fs`` opens (a shared folder, S3, GCS, HDFS).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from siftfield.llm.common import spread

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"
#: Column -> header field.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
FILE_BYTES, TASK_BYTES, CHUNK, MOVES = 64 << 20, 64 << 20, 1 << 20, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The extra field of a gzip member that tells the member's whole length.
MARK = b"SL"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file:///" + path.removeprefix("file:/").lstrip("/"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def member(data: bytes) -> bytes:
    """A gzip member that knows its length."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 12 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + MARK + struct.pack("<HI", 4, length)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row['payload'])}\r\n\r\n".encode()
    block = http + (row["payload"] if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['warc_date']}"]
    if row["target_uri"]:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", row["target_uri"]))
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Source:
    """A file read forward, with a look at the bytes ahead."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def need(self, n: int) -> bool:
        """Hold at least n bytes ahead, if the file has them."""
        if len(self.buffer) - self.at < n:
            parts, have = [self.buffer[self.at :]], len(self.buffer) - self.at
            while have < n and (more := self.file.read(max(CHUNK, n - have))):
                parts.append(more)
                have += len(more)
            self.buffer, self.at = b"".join(parts), 0
        return len(self.buffer) - self.at >= n

    def take(self, n: int) -> bytes:
        self.need(n)
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer) - self.at)
        self.at += have
        while n > have and (more := self.file.read(min(CHUNK, n - have))):
            have += len(more)


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(file, wanted, payloads: bool, decoded: Counter | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields and block of each wanted record; without ``payloads``, the block's first bytes.

    ``decoded`` counts the bytes that were decompressed and kept, and those that were dropped to find a member's end.
    """
    source, decoded = Source(file), Counter() if decoded is None else decoded
    while source.need(1):
        if source.need(2) and source.buffer[source.at : source.at + 2] == b"\x1f\x8b":
            length = None
            if source.need(20) and source.buffer[source.at + 3] & 4 and source.buffer[source.at + 12 : source.at + 14] == MARK:
                length = struct.unpack_from("<I", source.buffer, source.at + 16)[0]
            inflate = zlib.decompressobj(31)
            if length:
                source.need(length)

            def more() -> bytes:
                """The next bytes of the member, CHUNK at most; none at its end."""
                while not inflate.eof:
                    data = inflate.unconsumed_tail or (source.take(min(CHUNK, len(source.buffer) - source.at, left[0])) if source.need(1) else b"")
                    left[0] -= len(data) if not inflate.unconsumed_tail else 0
                    if not data:
                        return b""
                    if out := inflate.decompress(data, sizes[0]):
                        return out
                return b""

            left, sizes, parts = [length or 1 << 62], [4096], [b""]
            while b"\r\n\r\n" not in parts[0] and (part := more()):
                parts[0] += part
            head, _, rest = parts[0].partition(b"\r\n\r\n")
            names = fields(head)
            keep, sizes[0] = wanted(names), CHUNK
            decoded["kept"] += len(parts[0])
            parts = [rest]
            if (keep and payloads) or not length:  # else it's stepped over
                while part := more():
                    if keep and payloads:
                        parts.append(part)
                    decoded["kept" if keep and payloads else "dropped"] += len(part)
            if keep:
                yield names, b"".join(parts)[: int(names.get("content-length", 0))]
            if length:
                source.skip(left[0])
            else:
                source.at -= len(inflate.unused_data)
        else:
            while source.need(1) and source.buffer[source.at : source.at + 1] in (b"\r", b"\n"):
                source.at += 1
            n = 4096
            while source.need(n) and b"\r\n\r\n" not in source.buffer[source.at : source.at + n]:
                n *= 2
            end = source.buffer.find(b"\r\n\r\n", source.at)
            if end < 0:
                return
            names = fields(source.take(end + 4 - source.at))
            size = int(names.get("content-length", 0))
            if not wanted(names):
                source.skip(size)
            elif payloads:
                yield names, source.take(size)
            else:
                first = source.take(min(size, 4096))
                source.skip(size - len(first))
                yield names, first


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS or not isinstance(f, (EqualTo, In, StringStartsWith)):
                yield f
            else:
                self.tests.append((column, type(f).__name__, set(f.value) if isinstance(f, In) else f.value))

    def partitions(self) -> list[Files]:
        system, at = opened(self.path)
        info = system.get_file_info(at)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        groups, size = [], 0
        for x in sorted((x for x in infos if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and "/_" not in x.path), key=lambda x: x.path):
            if not groups or size + x.size > TASK_BYTES:
                groups, size = [*groups, Files([])], 0
            groups[-1].paths.append(x.path)
            size += x.size
        return groups

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        def bare(names: dict[str, str], column: str) -> str | None:
            value = names.get(HEADERS[column])
            return value and (value.strip("<>") if column in ("record_id", "refers_to") else value.removeprefix("sha1:") if column == "payload_digest" else value)

        def wanted(names: dict[str, str]) -> bool:
            for column, how, to in self.tests:
                value = bare(names, column)
                if value is None or not (value in to if how == "In" else value.startswith(to) if how == "StringStartsWith" else value == to):
                    return False
            return True

        system, _ = opened(self.path)
        schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.binary() if t == "binary" else pa.string()) for n, t in (x.split(" ") for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as file:
                for names, block in records(file, wanted, self.payload or self.verify):
                    http, _, payload = block.partition(b"\r\n\r\n") if names.get("content-type", "").startswith("application/http") else (b"", b"", block)
                    told = fields(http).get("content-length")
                    row = {c: bare(names, c) for c in HEADERS}
                    whole = row["record_type"] != "revisit"
                    if whole and self.verify and row["payload_digest"] and base32(hashlib.sha1(payload).digest()) != row["payload_digest"]:
                        raise ValueError(f"{path}: the payload of {row['record_id']} doesn't have the digest in its headers")
                    row["payload_bytes"] = len(payload) if whole and (self.payload or self.verify) else int(told) if told else None
                    row["payload"] = payload if whole and self.payload else None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    task: str | None  #: folder of the task's files


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_id, record_type, target_uri, warc_date, payload_digest, refers_to, payload."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.path)
        task = f"part-{uuid4().hex}"
        n, out, size = 0, None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    if not n:
                        system.create_dir(f"{at}/_temporary/{task}", recursive=True)
                    out, size, n = system.open_output_stream(f"{at}/_temporary/{task}/{n:05d}.warc.gz", compression=None), 0, n + 1
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(task if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        """Move each task's folder into place; several at a time, as there may be many."""
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        tasks = [m.task for m in messages if m and m.task]
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda t: system.move(f"{at}/_temporary/{t}", f"{at}/{t}"), tasks))
        self.clear(system, at)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*opened(self.path))

    @staticmethod
    def clear(system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_temporary")


class WarcSource(DataSource):
    """Options: path; payload (true), verify (false: compare each payload with its digest)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def as_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows to write: of pages with equal payloads of ``min_bytes`` or more, the one with the smallest
    id is the response and the others revisit it; smaller payloads are all responses.

    A null payload is empty.  Rows that repeat the smallest id are responses as well; null ids come
    after all others, and are responses where no other id has the payload.  Only digests and ids are
    grouped; the join on digests is one that the adaptive planner may split at a frequent payload.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = rows.filter(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(spread(first.filter("n > 1 and first is not null").select("sha1", "first")), "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return rows.select(
        urn("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"),
        "sha1", F.when(revisit, urn("first")).alias("refers_to"), "payload",
    )


def write_archives(rows: DataFrame, path: str) -> None:
    """Write rows of :func:`as_records` as archives under a folder that all executors share."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = pa.array([base32(bytes.fromhex(x)) for x in b.column(b.schema.get_field_index("sha1")).to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index("sha1"), "payload_digest", digests)

    kinds = ", ".join(f"{'payload_digest' if n == 'sha1' else n} {t}" for n, t in rows.dtypes)
    rows.sparkSession.dataSource.register(WarcSource)
    rows.mapInArrow(named, kinds).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """All records under a path; filter on record_type or a header column and whole records are skipped."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)
