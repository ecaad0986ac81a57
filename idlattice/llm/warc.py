"""Operator 9: WARC archives, written and read back by byte ranges.

Writing: one gzip member per record; archives are written by Spark's text sink, so
its commit protocol covers lost tasks and any file system that Spark writes to.
Its line separator, which it puts after each row, is an empty gzip member.
Reading: an archive is cut into byte ranges. A task looks for the gzip magic in its
range, validates a candidate by decoding the start of the member as a WARC header,
and owns the records that start inside its range, reading past its end for the last.
A member may hold several records. A candidate with a header that is none is no member;
one whose content breaks off is given as an incomplete record, so that none goes unseen.
A whole archive inside a payload that the outer member stores uncompressed is told
from members of its own only by what follows its last one.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, materialise, new_path, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of a range, of a read, and of what a task appends to an archive in one row.
RANGE, READ, ROW = 8 << 20, 1 << 20, 1 << 20
LEVEL = 4
#: Ranges of a read, at most; bytes in which a header must end.
MOST_RANGES, MOST_HEADER = 4000, 1 << 20
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MULTIPART = "urn:idlattice:page:"


def plan(pages: DataFrame, key: str = "page_id", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages with payload (binary), digest (SHA-256 hex), size and refers_to.

    refers_to: the least key with an equal payload of at least least_bytes, null for
    that key itself. Keys of repeated payloads are aggregated map-side; up to
    BROADCAST_ROWS of those payloads are broadcast to the pages, beyond that both
    sides are shuffled on the digest, which adaptive execution splits if one is hot.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    own = pages.select(key, "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("long").alias("size"))
    repeated = materialise(own.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = own.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("first") < F.col(key), F.col("first"))).drop("first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without the payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{MULTIPART}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{MULTIPART}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write(planned: DataFrame, path: str, key: str = "page_id", level: int = LEVEL, date: str | None = None) -> None:
    """Writes what plan() returns as archives in the folder path, one for each partition."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, size = [], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                row.append(packer.compress(record(*values, date)) + packer.flush())
                size += len(row[-1])
                if size >= ROW:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(row)], pa.binary())], ["value"])
                    row, size = [], 0
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(row)], pa.binary())], ["value"])

    rows = planned.select(key, "url", "payload", "digest", "size", "refers_to").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def ranges(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(path, start, stop) of all archives in a folder, found by Spark's own listing.

    size: bytes of a range; by default RANGE, or more where that would give over MOST_RANGES.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    if size is None:
        total = files.agg(F.sum("length")).first()[0] or 0
        size = max(RANGE, -(-total // MOST_RANGES))
    cut = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    return files.select("path", F.explode(cut).alias("start"), F.col("length")).select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))


class Window:
    """Bytes of a file from a start on, read as they are asked for and dropped when passed."""

    def __init__(self, file, start: int):
        self.file, self.start, self.held = file, start, bytearray()
        file.seek(start)

    def upto(self, stop: int) -> bool:
        """Holds the bytes before stop; False if the file ends earlier."""
        while self.start + len(self.held) < stop:
            if not (more := self.file.read(READ)):
                return False
            self.held += more
        return True

    def get(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return bytes(self.held[at - self.start : at - self.start + n])

    def find(self, what: bytes, at: int, stop: int) -> int:
        """The first place of what that begins before stop, or -1."""
        while at < stop:
            self.upto(min(stop, at + READ) + len(what) - 1)
            here = self.held.find(what, at - self.start, min(stop, at + READ) + len(what) - 1 - self.start)
            if here >= 0:
                return self.start + here
            at += READ
        return -1

    def drop(self, before: int) -> None:
        del self.held[: before - self.start]
        self.start = max(self.start, before)


@dataclass
class Member:
    content: bytes
    stop: int
    complete: bool


def header(content: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """The fields of the record at a place of a content, and where its payload begins; None if no whole WARC header is there."""
    if not content.startswith(b"WARC/1.", at) or (end := content.find(b"\r\n\r\n", at)) < 0:
        return None
    try:
        lines = [line.split(":", 1) for line in content[at:end].decode().split("\r\n")[1:]]
        fields = {name.strip(): value.strip() for name, value in lines}
        return (fields, end + 4) if int(fields["Content-Length"]) >= 0 else None
    except (ValueError, KeyError):
        return None


def member(window: Window, at: int) -> Member | None:
    """The gzip member at a place; None if none is there whose content is empty or begins with a WARC header, or if what follows it is neither a member nor the end."""
    unpack, content, place = zlib.decompressobj(31), b"", at
    parts: list[bytes] = []
    valid = False
    try:
        while not unpack.eof:
            data = window.get(place, READ if place > at else 4096)
            if not data:
                return Member(b"".join([content, *parts]), place, False) if valid else None
            out = unpack.decompress(data)
            place += len(data)
            if valid:
                parts.append(out)
                continue
            content += out
            if content and not content.startswith(b"WARC/1."[: len(content)]):
                return None
            if (valid := header(content) is not None) is False and (b"\r\n\r\n" in content or len(content) > MOST_HEADER):
                return None
    except zlib.error:
        return Member(b"".join([content, *parts]), max(at + 1, place), False) if valid else None
    if content and not valid:
        return None
    stop = place - len(unpack.unused_data)
    return Member(b"".join([content, *parts]), stop, True) if window.get(stop, len(MAGIC)) in (MAGIC, b"") else None


def records_in(file, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payloads of the records whose members start in [start, stop); the payload is None if it breaks off."""
    window, at = Window(file, start), start
    while (at := window.find(MAGIC, at, stop)) >= 0:
        window.drop(at)
        if (found := member(window, at)) is None:
            at += 1
            continue
        content, at = found.content, found.stop if found.complete else at + 1
        place = 0
        while told := header(content, place):
            fields, begin = told
            place = begin + int(fields["Content-Length"])
            yield fields, content[begin:place] if place <= len(content) else None
            while content[place : place + 1] in (b"\r", b"\n"):
                place += 1


def read(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(record_id, record_type, url, refers_to, payload, payload_digest, payload_bytes, complete) of all records.

    Of a revisit the payload is null, digest and length come from its header; of a
    response they are computed from the payload read. A record that breaks off is not
    complete, its payload, digest and length are null. What a header lacks is null.
    """
    fields = ["record_id", "record_type", "url", "refers_to", "payload", "payload_digest", "payload_bytes", "complete"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    spread = ranges(spark, path, size)
    spread = spread.repartition(max(1, spread.count()), "path", "start")

    def row(head: dict[str, str], body: bytes | None) -> tuple:
        own = lambda name: head.get(name, "").strip("<>") or None
        again, length = head.get("WARC-Type") == "revisit", head.get("X-Payload-Length", "")
        told = (own("WARC-Payload-Digest") or "").removeprefix("sha256:") or None
        if body is None:
            return own("WARC-Record-ID"), own("WARC-Type"), own("WARC-Target-URI"), own("WARC-Refers-To"), None, None, None, False
        digest, n = (told, int(length) if length.isdigit() else None) if again else (hashlib.sha256(body).hexdigest(), len(body))
        return own("WARC-Record-ID"), own("WARC-Type"), own("WARC-Target-URI"), own("WARC-Refers-To"), None if again else body, digest, n, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

        for batch in batches:
            for uri, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for head, body in records_in(file, start, stop):
                        rows.append(row(head, body))
                        held += len(body or b"")
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    schema = "record_id string, record_type string, url string, refers_to string, payload binary, payload_digest string, payload_bytes bigint, complete boolean"
    return spread.mapInArrow(run, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    Repeated rows give a record each. A null page_id stays null and is nobody's original.
    """
    return round_trip(table(spark, sf_dir, "pages"))


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    write(plan(pages), path := new_path(spark, "warc"))
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return read(spark, path).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
