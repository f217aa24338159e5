"""WARC archives as a Spark data source, and pages deduplicated into them.

`register` adds the format "warc".  Reading plans one partition for each group of
files of about `split_bytes`; a file is never cut.  A task walks the records of
its files: it reads a record's header first, holds it against the pushed
predicates (record type and every other header column), and passes over the block
of an unwanted record.  In an archive whose gzip members carry their lengths (the
"sl" field, which the writer adds) passing over is a seek, without inflating; in
other archives the bytes are inflated and thrown away, never decoded.  With
payload=false the blocks of wanted records are passed over in the same way after
their HTTP head.  Predicates on `file` drop whole files when partitions are planned.

Writing makes one gzip member a record and a warcinfo record a file, and starts a
new file after `file_bytes`.  Tasks write hidden files under names of their own,
which the driver renames once all tasks are done, so a task that runs twice
or is lost leaves nothing that a reader sees.  Paths are those of
pyarrow.fs: file, hdfs, s3, gs.

`archived` writes a response record for each page, or a revisit of the page with
the largest id that has the same payload.  The payloads are compared by SHA-256 and
never gathered: only a group's count and largest id are.  Groups above a
thousandth of all rows look their id up in a broadcast table (`common.looked_up`).

Defined results: a null payload is empty; pages with equal ids and payloads are
responses together if their id is the largest; a page without an id revisits
the largest id with its payload, and is a response where there is none; a null
url leaves its header out, and characters in it that a header can't hold are
percent-encoded.  Payloads of any length that a binary cell holds are whole. Extra
columns take no part.  An empty table gives an archive without records.  Bytes that
aren't a record raise ValueError, as does a payload that differs from its digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import looked_up, written

CRLF = b"\r\n"
SPLIT_BYTES = FILE_BYTES = 64 << 20
CHUNK, BATCH_BYTES, BATCH_ROWS, MOST_HEAD = 1 << 16, 8 << 20, 1000, 1 << 20
DATE = "1970-01-01T00:00:00Z"

#: Header fields that have a column, as the file format spells them.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length",
}
SCHEMA = "file string, offset bigint, " + ", ".join(f"{c} {'bigint' if c == 'content_length' else 'string'}" for c in FIELDS) + ", headers map<string,string>, payload_bytes bigint, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- bytes of records -------------------------------------------------------


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that carries its own lengths, for readers that pass over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 14 + len(body) + 8
    if whole >> 32 or len(data) >> 32:  # too long for the field: a plain member
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, whole, len(data)) + body + tail


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record: header lines, blank line, block, two line ends."""
    lines = [f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None]
    return CRLF.join([b"WARC/1.1", *lines, b"", block, b"", b""])


def page_record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = kind == "revisit"
    return record(
        [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", None if uri is None else safe_uri(uri)),
            ("WARC-Profile", REVISIT if revisit else None), ("WARC-Refers-To", refers_to if revisit else None),
            ("WARC-Payload-Digest", "sha1:" + sha1_digest(payload)), ("Content-Type", "application/http;msgtype=response"),
        ],
        head if revisit else head + payload,
    )


def safe_uri(uri: str) -> str:
    """The address with white space, control and non-ASCII characters percent-encoded."""
    return quote(uri, safe="".join(map(chr, range(0x21, 0x7F))))


class Plain:
    """The bytes of a file in order, with a cheap skip."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def tell(self) -> int:
        return self.at - len(self.held)

    def more(self) -> bytes:
        got = self.file.read_at(min(CHUNK, self.size - self.at), self.at)
        self.at += len(got)
        return got

    def fill(self, n: int) -> bool:
        """Holds n bytes, if the file has them."""
        parts, have = [self.held], len(self.held)
        while have < n and (got := self.more()):
            parts.append(got)
            have += len(got)
        self.held = b"".join(parts)
        return have >= n

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("a record ends before its length")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def until(self, mark: bytes, most: int = MOST_HEAD) -> bytes:
        """The bytes up to and with the mark."""
        seen = 0
        while (end := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most or not (got := self.more()):
                raise ValueError("a header without an end")
            self.held += got
        return self.take(end + len(mark))

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
            return
        self.at += n - len(self.held)
        self.held = b""
        if self.at > self.size:
            raise ValueError("a record ends before its length")


class Gzip(Plain):
    """The inflated bytes of a file of gzip members; tell() is the place of the member.

    `passed` counts bytes of the file that were never inflated.
    """

    def __init__(self, file) -> None:
        super().__init__(file)
        self.unpacker, self.raw, self.start, self.passed = None, b"", 0, 0
        self.next, self.left = None, 0  # where the next member starts; inflated bytes that this one still holds

    def tell(self) -> int:
        return self.start if self.held or self.unpacker else self.at - len(self.raw)

    def _open(self) -> bool:
        while len(self.raw) < 24 and (got := super().more()):
            self.raw += got
        if not self.raw:
            return False
        self.start, self.next, self.left = self.at - len(self.raw), None, 0
        if self.raw[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {self.start}")
        if len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[12:16] == b"sl\x08\x00":
            whole, self.left = struct.unpack("<II", self.raw[16:24])
            self.next = self.start + whole
        self.unpacker = zlib.decompressobj(31)
        return True

    def more(self) -> bytes:
        while self.unpacker or self._open():
            if not self.raw:
                self.raw = super().more()
                if not self.raw:
                    raise ValueError("a gzip member without an end")
            got = self.unpacker.decompress(self.raw, CHUNK)
            self.raw = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            self.left -= len(got)
            if self.unpacker.eof:
                self.unpacker = None
            if got:
                return got
        return b""

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if self.unpacker and self.next and n >= self.left - 2 * len(CRLF):  # only the line ends of the member follow
                n = max(0, n - self.left)
                self.passed += max(0, self.next - self.at)
                self.raw = self.raw[len(self.raw) - (self.at - self.next) :] if self.at > self.next else b""
                self.at, self.unpacker = max(self.at, self.next), None
                if not n:
                    return
            self.held = self.more()
            if not self.held:
                raise ValueError("a record ends before its length")
        self.held = self.held[n:]


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a header by name in lower case; continued lines are joined."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def walk(stream: Plain, wanted, payload: bool, verify: bool) -> Iterator[dict]:
    """Wanted records of a stream; `wanted` judges a header's columns before its block is read."""
    while True:
        while stream.fill(2) and stream.held[:2] == CRLF:
            stream.take(2)
        if not stream.fill(1):
            return
        at = stream.tell()
        head = stream.until(CRLF + CRLF)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        fields = parse_head(head)
        length = int(fields["content-length"])
        row = {c: fields.get(f.lower()) for c, f in FIELDS.items()} | {"content_length": length}
        if not wanted(row):
            stream.skip(length)
            continue
        row |= {"offset": at, "headers": list(fields.items()), "payload_bytes": length, "payload": None}
        left = length
        if (row["content_type"] or "").startswith("application/http"):
            http = stream.until(CRLF + CRLF)
            left -= len(http)
            told = parse_head(http).get("content-length", "")
            row["payload_bytes"] = int(told) if row["record_type"] == "revisit" and told.isdigit() else left
        if payload and row["record_type"] != "revisit":
            row["payload"], left = stream.take(left), 0
            digest = row["payload_digest"] or ""
            if verify and digest.startswith("sha1:") and digest[5:] != sha1_digest(row["payload"]):
                raise ValueError(f"the payload of {row['record_id']} differs from its digest")
        stream.skip(left)
        yield row


# ---- predicates ---------------------------------------------------------------


def holds(f: ds.Filter, row: dict) -> bool | None:
    """SQL's answer of a pushed predicate: None where it is unknown."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    x = row[f.attribute[0]]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return (x is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    y = f.value
    if x is None or y is None:
        return None
    if isinstance(f, ds.In):
        return True if x in [v for v in y if v is not None] else None if None in y else False
    compare = {
        ds.EqualTo: lambda: x == y, ds.GreaterThan: lambda: x > y, ds.GreaterThanOrEqual: lambda: x >= y, ds.LessThan: lambda: x < y, ds.LessThanOrEqual: lambda: x <= y,
        ds.StringStartsWith: lambda: x.startswith(y), ds.StringEndsWith: lambda: x.endswith(y), ds.StringContains: lambda: y in x,
    }
    return compare[type(f)]()


PUSHED = (ds.Not, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.In, ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


def pushable(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return pushable(f.child)
    return isinstance(f, PUSHED) and len(f.attribute) == 1 and f.attribute[0] in ("file", *FIELDS)


# ---- the data source ----------------------------------------------------------


class Files(ds.InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


@dataclass
class Made(ds.WriterCommitMessage):
    files: list[str]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(system: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """Files of a folder, or the file itself; hidden names (_ or .) don't count."""
    own = system.get_file_info(folder)
    if own.type == pafs.FileType.File:
        return [own]
    found = system.get_file_info(pafs.FileSelector(folder, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(folder) :].split("/") if x)
    return sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f.path)), key=lambda f: f.path)


def _rows(batch: pa.RecordBatch, at_once: int = 16) -> Iterator[dict]:
    """Rows of a batch as Python objects, few at a time as payloads may be long."""
    for s in range(0, batch.num_rows, at_once):
        yield from batch.slice(s, at_once).to_pylist()


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload, self.verify = (options.get(x, "true").lower() == "true" for x in ("payload", "verify"))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def _of(self, name: str) -> list[ds.Filter]:
        inner = lambda f: inner(f.child) if isinstance(f, ds.Not) else f.attribute[0]
        return [f for f in self.filters if (inner(f) == "file") == (name == "file")]

    def partitions(self):
        system, folder = _opened(self.path)
        groups, room = [], 0
        for f in _listed(system, folder):
            if not all(holds(x, {"file": f.path}) for x in self._of("file")):
                continue
            if room < f.size or not groups:
                groups.append([])
                room = self.split_bytes
            groups[-1].append(f.path)
            room -= f.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        system, _ = _opened(self.path)
        filters = self._of("header")
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(c, pa.int64() if c == "content_length" else pa.string()) for c in FIELDS], ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                stream = Gzip(file) if path.endswith(".gz") else Plain(file)
                for row in walk(stream, lambda r: all(holds(f, r) for f in filters), self.payload, self.verify):
                    rows.append(row | {"file": path})
                    held += 1000 + len(row["payload"] or b"")
                    if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows with record_type, record_id, target_uri, refers_to and payload; other columns are left out."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes, self.level, self.date = int(options.get("file_bytes", FILE_BYTES)), int(options.get("level", 6)), options.get("date", DATE)

    def write(self, iterator):
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        made, out, used = [], None, 0
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:lodestone:archive>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        try:
            for batch in iterator:
                for row in _rows(batch.select(["record_type", "record_id", "target_uri", "refers_to", "payload"])):
                    if out is None or used >= self.file_bytes:
                        if out is not None:
                            out.close()
                        made.append(f"_part-{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{folder}/{made[-1]}", compression=None)
                        used = out.write(member(info, self.level))
                    used += out.write(member(page_record(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload"] or b"", self.date), self.level))
        finally:
            if out is not None:
                out.close()
        return Made(made)

    def commit(self, messages):
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in _listed(system, folder):
                system.delete_file(f.path)
        for name in [x for m in messages if m for x in m.files]:
            system.move(f"{folder}/{name}", f"{folder}/{name[1:]}")

    def abort(self, messages):
        system, folder = _opened(self.path)
        for name in [x for m in messages if m for x in m.files]:
            system.delete_file(f"{folder}/{name}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Adds the format and lets Spark hand predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)


# ---- pages ----------------------------------------------------------------------


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(record_type, record_id, target_uri, refers_to, payload) of every page."""
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    kept = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
    repeated = written(kept.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL"), "repeated")
    both = looked_up(rows, repeated, "digest", "n", F.xxhash64("page_id", "target_uri"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return both.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), "target_uri", F.when(revisit, urn(F.col("first"))).alias("refers_to"), "payload")


def archived(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> None:
    """Writes the pages as WARC files below `path`."""
    register(pages.sparkSession)
    decided(pages, page_id, url, html, least_bytes).write.format("warc").options(**options).mode("append").save(path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records of an archive.

    Responses are decoded and held against their digests; of revisits the headers alone are read.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")
    out = [number("record_id").alias("page_id"), "payload_bytes", F.expr("substring(payload_digest, 6)").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")]
    responses = records(spark, path).filter("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    revisits = records(spark, path, payload=False).filter("record_type = 'revisit'")
    return responses.select(*out).unionByName(revisits.select(*out))
