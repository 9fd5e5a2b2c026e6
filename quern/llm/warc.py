"""WARC archives as a Python data source, and page archiving with revisit records.

Reading (``spark.read.format("warc")``): partitions are planned from the archive's manifest, which lists committed files
and record offsets every ``SPLIT_BYTES``; a folder without one is read a file a partition (plain or gzip by member). Filters on header
columns are pushed down: headers are parsed first, and a record that they rule out is passed over by its content
length, its payload neither read nor decoded. The option ``payload`` says what happens with the others: ``read`` (default),
``verify`` (hashed against the digest of the header, not returned) or ``skip``.

Writing (``df.write.format("warc")``): each task writes a file with a name of its own; only files of finished tasks enter
the manifest at commit, so what a lost task left is never read.

Archiving pages: of the pages with equal payloads of at least ``least`` bytes the one with the largest id is the
response, the others are revisits that refer to it; smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url leaves the target out; a null page_id is kept as null and is the
response of a group only if all ids of it are null; rows that repeat the largest id are all responses; an empty table
writes an empty archive; other columns are ignored. A payload that differs from its digest raises.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .staging import Stages, small_side
from .tokens import _fs, read_bytes, write_bytes

LEAST_BYTES = 1000
SPLIT_BYTES = 16 << 20
#: Records of a batch that is handed on, and bytes of their payloads.
ROWS, BATCH_BYTES = 512, 8 << 20
SCHEMA = "path string, offset long, type string, record_id string, target_uri string, date string, content_type string, content_length long, payload_digest string, payload_bytes long, refers_to string, payload binary"
INPUT = "type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = {
    "type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "refers_to": "warc-refers-to",
}
TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
    IsNull: lambda x, v: x is None,
    IsNotNull: lambda x, v: x is not None,
}


@dataclass
class Chunk(InputPartition):
    path: str
    start: int
    end: int  # -1: to the end of the file


@dataclass
class Wrote(WriterCommitMessage):
    path: str
    size: int
    marks: list[int]


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, [f.name for f in schema])


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.payload = options.get("payload", "read")
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes every test of one header column; the rest stays with Spark."""
        for f in filters:
            inner, wanted = (f.child, False) if isinstance(f, Not) else (f, True)
            column = getattr(inner, "attribute", ())
            nulls = isinstance(inner, (IsNull, IsNotNull))
            if type(inner) in TESTS and len(column) == 1 and column[0] != "payload" and (wanted or nulls):
                self.tests.append((type(inner).__name__, column[0], getattr(inner, "value", None), wanted))
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        from pyarrow import fs

        system, base = _fs(self.folder)
        if system.get_file_info(f"{base}/manifest.json").type == fs.FileType.File:
            files = json.loads(read_bytes(f"{self.folder}/manifest.json"))
            return [
                Chunk(f["path"], lo, hi) for f in files for lo, hi in zip(f["marks"], [*f["marks"][1:], f["size"]], strict=True)
            ] or [Chunk("", 0, 0)]
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(f.path for f in found if f.path.endswith((".warc", ".warc.gz")))
        return [Chunk(self.folder + n[len(base) :], 0, -1) for n in names] or [Chunk("", 0, 0)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        by_name = {t.__name__: test for t, test in TESTS.items()}
        tests = [(column, by_name[kind], value, wanted) for kind, column, value, wanted in self.tests]
        system, path = _fs(partition.path)
        rows: list[dict] = []
        held = 0
        with system.open_input_file(path) as file:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 20) if path.endswith(".gz") else io.BufferedReader(_Raw(file), 1 << 20)
            stream.seek(partition.start)
            while partition.end < 0 or stream.tell() < partition.end:
                row = self._record(stream, tests)
                if row is None:
                    break
                if row:
                    rows.append(row | {"path": partition.path})
                    held += len(row["payload"] or b"")
                if len(rows) >= ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _record(self, stream, tests) -> dict | None:
        """The next record; {} if the tests rule it out, None at the end."""
        at = stream.tell()
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            at, line = stream.tell(), stream.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at} of {self.folder}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        row = {k: headers.get(v) for k, v in NAMES.items()}
        for k in ("record_id", "refers_to"):
            row[k] = row[k].strip("<>") if row[k] else None
        length = int(headers.get("content-length", 0))
        digest = headers.get("warc-payload-digest")
        if digest and digest.startswith("sha1:"):
            digest = base64.b32decode(digest[5:]).hex()
        size = headers.get("warc-payload-length")
        row |= {"offset": at, "content_length": length, "payload_digest": digest, "payload_bytes": int(size) if size else None}
        if not all(test(row[column], value) == wanted for column, test, value, wanted in tests):
            stream.seek(length, io.SEEK_CUR)
            return {}
        if self.payload == "skip" or row["type"] == "revisit":
            stream.seek(length, io.SEEK_CUR)
            return row | {"payload": None}
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"record at byte {at} ends early")
        payload = body.partition(b"\r\n\r\n")[2] if (row["content_type"] or "").startswith("application/http") else body
        if self.payload == "verify" and digest and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload at byte {at} differs from its digest")
        return row | {"payload": payload if self.payload == "read" else None}


class _Raw(io.RawIOBase):
    """A pyarrow file as a raw stream."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str]):
        self.folder = options["path"].rstrip("/")
        self.gzip = str(options.get("gzip", "false")).lower() == "true"
        self.columns = columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        path = f"{self.folder}/{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        size, marks, stream = 0, [], None
        for batch in iterator:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for k in range(batch.num_rows):
                data = record(**{c: x[k].as_py() for c, x in zip(self.columns, columns, strict=True)})
                if stream is None:
                    system, at = _fs(path)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    stream = system.open_output_stream(at, compression=None)
                if not marks or size - marks[-1] >= SPLIT_BYTES and not self.gzip:
                    marks.append(size)
                data = gzip.compress(data, 1) if self.gzip else data
                stream.write(data)
                size += len(data)
        if stream is not None:
            stream.close()
        return Wrote(path, -1 if self.gzip else size, marks)

    def commit(self, messages: list[Wrote | None]) -> None:
        files = sorted((m.__dict__ for m in messages if m and m.marks), key=lambda f: f["path"])
        write_bytes(f"{self.folder}/manifest.json", json.dumps(files).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        for m in messages:
            if m and m.marks:
                system, path = _fs(m.path)
                system.delete_file(path)


def record(
    type: str,
    record_id: str,
    target_uri: str | None,
    date: str,
    payload_digest: str,
    payload_bytes: int,
    refers_to: str | None,
    payload: bytes | None,
) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head alone."""
    block = HTTP if type == "revisit" else HTTP + (payload or b"")
    head = {
        "WARC-Type": type,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": target_uri and "".join(target_uri.split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(payload_digest)).decode(),
        "WARC-Payload-Length": payload_bytes,
        "WARC-Profile": PROFILE if type == "revisit" else None,
        "WARC-Refers-To": f"<{refers_to}>" if refers_to else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, folder: str, stages: Stages, least: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes page_id, url, html as an archive in ``folder``."""
    register(pages.sparkSession)
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    again = page.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.max("page_id").alias("kept"),
        F.count("*").alias("n"),
    ).where("n > 1").select("payload_digest", "kept")
    again = small_side(stages.put(again, "repeated"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.coalesce((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("kept")) & F.col("kept").isNotNull(), F.lit(False))
    rows = page.join(again, "payload_digest", "left").withColumn("revisit", revisit)
    rows.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        "payload_digest",
        "payload_bytes",
        F.when(F.col("revisit"), urn("kept")).alias("refers_to"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def archived(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages and reads the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    stages = Stages(pages.sparkSession, "warc")
    folder = stages.folder("archive")
    archive(pages, folder, stages, least)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) as bigint)")
    back = pages.sparkSession.read.format("warc").option("payload", "verify").load(folder).where(F.col("type").isin("response", "revisit"))
    return back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
