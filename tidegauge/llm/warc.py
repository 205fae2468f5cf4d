"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with the records of about
FRAME_BYTES, so one record is read by decompressing one frame. Then come a skippable frame
with the index (for every record: its identifier, frame, and offset and length within the
decompressed frame) and the seek table, a skippable frame that lists the compressed and
decompressed size of each frame and ends in a fixed footer. Any Zstandard reader reads the
records as one stream; a reader of the footer seeks.

Records with equal payloads (length and SHA-1) are stored once: the one with the largest
identifier is the response, the others are revisits that refer to it. Copies are counted
before anything is joined, and only identifiers of payloads that occur twice are joined, so
a payload held by a third of the pages is a skewed join that Spark splits.

Null payloads count as empty. A null identifier sorts below all others. Rows that tie on the
largest identifier of a payload are all responses. Null addresses have no target header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.base import new_path, query, table
from tidegauge.llm.blobs import read_files, write_files

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 4 << 20
LEVEL = 3
# Fixed values of the seekable format.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
ENDING = struct.pack("<I", FOOTER_MAGIC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ENTRY = struct.Struct("<qBIIQ")
_HEADER = re.compile(rb"([^:\r\n]+):[ ]?([^\r\n]*)\r\n")


def record(
    identifier: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, which holds no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if identifier is None else identifier}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def parse(data: bytes) -> dict:
    """A record's headers, and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head + b"\r\n")}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(_HEADER.findall(http + b"\r\n"))[b"Content-Length"])
    headers["payload-length"] = length
    headers["payload"] = payload if headers["warc-type"] == "response" else None
    return headers


def _number(urn: str | None) -> int | None:
    if urn is None:
        return None
    own = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if own == "none" else int(own)


class Bundle:
    """Records on their way into one file."""

    def __init__(self):
        self.frames, self.entries, self.open, self.size = [], [], [], 0
        self.done = bytearray()
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, identifier: int | None, data: bytes) -> None:
        known = identifier is not None
        self.entries.append((identifier if known else 0, known, len(self.frames), self.size, len(data)))
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.cut()

    def cut(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append((len(frame), self.size))
            self.done += frame
            self.open, self.size = [], 0

    def close(self) -> bytes:
        """The file without its last four bytes, which the writer of files adds."""
        self.cut()
        index = struct.pack("<I", len(self.entries)) + b"".join(_ENTRY.pack(*e) for e in self.entries)
        self.done += struct.pack("<II", INDEX_MAGIC, len(index)) + index
        frames = [*self.frames, (len(index) + 8, 0)]
        seek = b"".join(struct.pack("<II", *f) for f in frames)
        footer = struct.pack("<IB", len(frames), 0)
        self.done += struct.pack("<II", SEEK_MAGIC, len(seek) + 9) + seek + footer
        return bytes(self.done)


class Reader:
    """Random access to the records of one file."""

    def __init__(self, data: bytes):
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end")
        table_at = len(data) - 9 - 8 * count
        sizes = [struct.unpack_from("<II", data, table_at + 8 * i) for i in range(count)]
        self.data, self.frames, at = data, [], 0
        for compressed, size in sizes:
            self.frames.append((at, compressed, size))
            at += compressed
        index_at = self.frames[-1][0] + 8
        (entries,) = struct.unpack_from("<I", data, index_at)
        self.entries = [_ENTRY.unpack_from(data, index_at + 4 + _ENTRY.size * i) for i in range(entries)]
        self.held: tuple[int, bytes] = (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.held[0] != frame:
            at, compressed, size = self.frames[frame]
            own = zstandard.ZstdDecompressor().decompress(self.data[at : at + compressed], max_output_size=size)
            self.held = (frame, own)
        return self.held[1][offset : offset + length]


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``sha1`` (hex) and ``keeper``, the identifier that a copy refers to, else null."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.sha1(data).alias("sha1"), F.octet_length(data).alias("bytes"))
    copied = (
        own.groupBy("sha1", "bytes").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & (F.col("bytes") >= least_bytes)).drop("n")
    )
    below = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return own.join(copied, ["sha1", "bytes"], "left").select(
        "page_id", "url", "html", "sha1", F.when(below, F.col("largest")).alias("keeper")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) to ``folder``, a record per row."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bundle()
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                own.add(
                    row["page_id"],
                    record(row["page_id"], row["url"], payload, bytes.fromhex(row["sha1"]), row["keeper"], date),
                )
                if len(own.done) >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([own.close()], pa.binary())})
                    own = Bundle()
        if own.entries:
            yield pa.RecordBatch.from_pydict({"file": pa.array([own.close()], pa.binary())})

    write_files(with_roles(pages, least_bytes).mapInArrow(bundle, "file binary"), "file", folder, ENDING)


_INDEX = "page_id long, path string, frame int, offset long, length long"
_RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record is: file, frame, and offset and length within the frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                rows = [
                    {"page_id": i if known else None, "path": path, "frame": f, "offset": o, "length": n}
                    for i, known, f, o, n in Reader(data).entries
                ]
                yield pa.RecordBatch.from_pylist(rows, _arrow(_INDEX))

    return read_files(spark, folder).mapInArrow(run, _INDEX)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def read_archives(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """The records of all files, with payloads; with ``wanted`` (page_id), only those records.

    Only frames that hold a wanted record are decompressed. A response's digest is checked.
    """
    files = read_files(spark, folder).select("path", "content", F.lit(None).cast("array<struct<f:int,o:long,n:long>>").alias("spots"))
    if wanted is not None:
        spots = (
            read_index(spark, folder).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
            .groupBy("path").agg(F.sort_array(F.collect_list(F.struct(
                F.col("frame").alias("f"), F.col("offset").alias("o"), F.col("length").alias("n")
            ))).alias("spots"))
        )
        files = files.drop("spots").join(spots, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, spots in zip(*(batch.column(c).to_pylist() for c in ("content", "spots")), strict=True):
                reader = Reader(data)
                places = [(e[2], e[3], e[4]) for e in reader.entries]
                if spots is not None:
                    places = [(s["f"], s["o"], s["n"]) for s in spots]
                for start in range(0, len(places), 256):
                    rows = [_row(reader.read(*p)) for p in places[start : start + 256]]
                    yield pa.RecordBatch.from_pylist(rows, _arrow(_RECORD))

    return files.mapInArrow(run, _RECORD)


def _row(data: bytes) -> dict:
    headers = parse(data)
    digest, payload = headers["warc-payload-digest"].removeprefix("sha1:"), headers["payload"]
    if payload is not None:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != headers["payload-length"]:
            raise ValueError(f"{headers['warc-record-id']}: the payload does not match its digest")
    return {
        "page_id": _number(headers["warc-record-id"]),
        "record_type": headers["warc-type"],
        "refers_to": _number(headers.get("warc-refers-to")),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": headers["payload-length"],
        "payload_digest": digest,
        "payload": payload,
    }


_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
    SELECT *, max(page_id) OVER (PARTITION BY h, n) AS largest FROM p
), b AS (
    SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
        ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100',
         '1101', '1110', '1111'][instr('0123456789abcdef', substr(h, i, 1))]), 'string_agg', '') AS bits
    FROM k
)
SELECT page_id, n::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT
        + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT
        + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM b
"""


@query("op3_seekable_warc", _SQL)
def _warc(spark, folder):
    """Every page written to an archive and read back."""
    pages = table(spark, folder, "pages")
    archive = new_path(spark, "warc")
    write_archives(pages, archive)
    return read_archives(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
