"""WARC archives: a writer on Spark's own file commit, and a splittable reader of gzip members."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import row_map, scratch, table, text_bytes

MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from so many bytes on are written once and revisited.
REVISIT_BYTES = 1000
#: Bytes of a split, of one read, and gzip's level.
SPLIT_BYTES, READ_BYTES, LEVEL = 16 << 20, 1 << 18, 4
#: An empty gzip member: its last byte is zero, as that of any member of less than 16 MB is.
EMPTY = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, file string, at bigint"

_TYPES = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
_RECORD_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])


def member(record: bytes) -> bytes:
    """Whole gzip members that hold a record; the last byte is zero in any case."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + EMPTY


def _line(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    block = http
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str) -> None:
    """Writes a record for each page (page_id, url, html; other columns are ignored) under path, a gzip member each.

    A null html is an empty payload. Of equal payloads of at least REVISIT_BYTES, that of the largest page_id
    is a response (all its rows, if repeated), others revisit it. A page without id never is revisited; it
    revisits the largest id of its payload, if any has one. The files go through Spark's text writer: a row is a member
    without its last byte, and the line's end is that byte, zero. So any store that Spark writes will do,
    and tasks of lost executors are committed once.
    """
    payload = text_bytes("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    shared = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload")).filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy(F.sha1("payload").alias("digest"))
    shared = shared.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for page_id, url, payload, digest, refers_to in rows:
                name = _name(page_id)
                out = member(record(name, url, payload, digest, None if refers_to is None else _name(refers_to)))
                yield (out[:-1],), len(out)

        return step

    members = row_map(rows, "value binary", start, pa.schema([("value", pa.binary())]))
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def _name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


class _Window:
    """Bytes of an open file by position, read in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, READ_BYTES), self.size - at))
        return self.held[at - self.at : at - self.at + n]


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, content) of each whole gzip member that starts in [start, end) and holds a WARC record.

    Positions that hold the magic are candidates; one is a member if its header is sound, what it inflates
    to begins as a record does, and its checksum holds. After a member the next is expected at its end.
    """
    window = _Window(file, size)
    at = start
    while at < end:
        piece = window.get(at, min(READ_BYTES, size - at))
        found = piece.find(MAGIC)
        if found < 0:
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        content = _inflate(window, at)
        if content is None:
            at += 1
            continue
        body, after = content
        if body:
            yield at, body
        at = after


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    if len(head := window.get(at, min(10, window.size - at))) < 10 or head[3] & 0xE0:
        return None
    z = zlib.decompressobj(31)
    parts: list[bytes] = []
    where = at
    try:
        while not z.eof:
            piece = window.get(where, min(READ_BYTES // 4, window.size - where))
            if not piece:
                return None
            parts.append(z.decompress(piece))
            where += len(piece)
            begin = parts[0][:5]
            if begin and not b"WARC/".startswith(begin) and begin != b"WARC/":
                return None
    except zlib.error:
        return None
    return b"".join(parts), where - len(z.unused_data)


def parse(body: bytes) -> dict | None:
    """Fields of a record; None if its head is no WARC head."""
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return None
    fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines[1:])}
    block = rest[: int(fields.get("content-length") or 0)]
    http, _, payload = block.partition(b"\r\n\r\n") if "http" in fields.get("content-type", "") else (b"", b"", block)
    named = (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if kind == "revisit":  # the payload stays with the record that this refers to
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        n, digest, payload = int(length[1]) if length else 0, named, None
    elif named and named != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
    name = lambda key: fields[key].strip("<>") if key in fields else None
    return {"record_id": name("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": name("warc-refers-to"), "payload": payload, "payload_bytes": n, "payload_digest": digest}


def _open(path: str):
    if path.startswith("file:") or "://" not in path:
        return open(re.sub(r"^file:(//)?(?=/)", "", path), "rb")
    store, place = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def _reaches(path: str) -> bool:
    """Whether tasks can open files of the path's store themselves."""
    if path.startswith("file:") or "://" not in path:
        return True
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files under a folder with their lengths, by the store's own listing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return [(f.getPath().toString(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives under path: one row each, of RECORD_SCHEMA; payload is null for revisits.

    Files are cut into byte ranges that need not meet members' bounds; a task owns the records that
    start inside its range, and reads past the end for the last. Empty files and folders give none; so do
    members that are cut off or hold no record. Files of a store that only Hadoop knows come through Spark's binary source,
    each whole (at most 2 GB).
    """
    if not _reaches(path):
        return _read_whole(spark, path)
    splits = [(name, size, a, min(size, a + split_bytes)) for name, size in files(spark, path) for a in range(0, size, split_bytes)]
    frame = spark.createDataFrame(splits, "file string, size bigint, start bigint, stop bigint").repartition(max(1, len(splits)), F.monotonically_increasing_id())

    def begin() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for name, size, a, b in rows:
                with _open(name) as file:
                    for at, body in members(file, size, a, b):
                        if (found := parse(body)) is not None:
                            yield (*found.values(), name, at), len(body)

        return step

    return row_map(frame, RECORD_SCHEMA, begin, _RECORD_ARROW)


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    def begin() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for name, content in rows:
                for at, body in members(io.BytesIO(content), len(content), 0, len(content)):
                    if (found := parse(body)) is not None:
                        yield (*found.values(), name, at), len(body)

        return step

    frame = spark.read.format("binaryFile").load(path).filter(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "content")
    return row_map(frame, RECORD_SCHEMA, begin, _RECORD_ARROW)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    number = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1)
    return read(spark, path).select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as first from p where strlen(h) >= 1000 group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from p left join g on p.h = g.h
"""
