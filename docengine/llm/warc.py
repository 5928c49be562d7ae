"""WARC archives, Zstandard-compressed: a dictionary, then one frame per record.

An archive begins with a skippable frame that holds the dictionary of its records
(none when there was too little to learn from); every record is a frame of its
own that names its content size and has a checksum. Archives are written by
Spark's own committed writer, one per task, so a lost task leaves no half archive.
The writer ends each row with a line feed, which an empty skippable frame of one
byte takes in; any Zstandard reader passes over it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import parts_of, strings

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
LINE_END_FRAME = struct.pack("<II", 0x184D2A50, 1)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 32 * 1024
SAMPLE_BYTES = 2 * 1024 * 1024
ROW_BYTES = 1024 * 1024
ROW_OVERHEAD = 1024  # bytes that a record takes without its payload, about
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload binary"
)
DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def choose_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``record_type`` and ``refers_to``.

    Of the pages whose payloads (null: empty) are equal and have at least
    ``min_bytes`` bytes, the one with the smallest id is the response and the others
    revisit it. Repeated rows with that id are responses all, and so are pages
    without an id (nobody could name what they revisit) and shorter payloads.
    Only digests are grouped; a payload that very many pages share is counted
    before the shuffle.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.unhex(F.sha2(html.cast("binary"), 256))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        html.alias("html"),
        digest.alias("digest"),
    )
    keys = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        digest.alias("digest"),
        F.octet_length(html).alias("size"),
    )
    first = (
        keys.filter(F.col("size") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
        .filter((F.col("pages") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    revisit = F.col("page_id") > F.col("first")
    return rows.join(first, "digest", "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, kind: str, refers_to) -> bytes:
    """One WARC record. The block of a response is an HTTP message; that of a
    revisit its header alone."""
    uri = re.sub(r"[\x00-\x20\x7f]", "", url or "") or f"urn:page:{page_id}"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode("ascii")
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields.insert(1, ("WARC-Profile", REVISIT_PROFILE))
        fields.insert(2, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    header = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return VERSION + b"\r\n" + header.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the records, empty when they are too few to learn from."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_rows(records: Iterator[bytes]) -> Iterator[bytes]:
    """An archive in parts: the dictionary's frame, then frames of records."""
    samples, size = [], 0
    for each in records:
        samples.append(each)
        size += len(each)
        if size >= SAMPLE_BYTES:
            break
    if not samples:
        return
    trained = train_dictionary(samples)
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
    part = bytearray()
    if trained:
        part += struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained

    def every():
        yield from samples
        yield from records

    for each in every():
        part += compressor.compress(each)
        if len(part) >= ROW_BYTES:
            yield bytes(part + LINE_END_FRAME)
            part = bytearray()
    if part:
        yield bytes(part + LINE_END_FRAME)


def write_archives(records: DataFrame, folder: str) -> None:
    """Write rows of ``choose_records``: one archive per task that has rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            for batch in parts_of(batches, ROW_BYTES):
                for page_id, url, html, kind, refers in zip(
                    batch.column("page_id").to_pylist(),
                    batch.column("url").to_pylist(),
                    strings(batch.column("html")),
                    batch.column("record_type").to_pylist(),
                    batch.column("refers_to").to_pylist(),
                ):
                    yield record(page_id, url, html.encode("utf-8"), kind, refers)

        for row in archive_rows(made()):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["part"])

    rows = records.select("page_id", "url", "html", "record_type", "refers_to")
    as_text(rows.mapInArrow(parts, "part binary"), "part").write.text(folder)


def as_text(rows: DataFrame, column: str) -> DataFrame:
    """Binary rows for the text writer, which writes their bytes as they are."""
    return rows.select(F.col(column).cast("string").alias("value"))


def frames(archive: bytes | memoryview) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    at, options = 0, {}
    while at < len(archive):
        if len(archive) - at < 8:
            raise ValueError("an archive ends within a frame's header")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(archive):
                raise ValueError("an archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("a dictionary that does not lead its archive")
                trained = bytes(archive[8 : 8 + size])
                if trained[:4] == struct.pack("<I", FRAME_MAGIC):  # may be compressed itself
                    trained = zstandard.ZstdDecompressor().decompress(trained)
                options = {"dict_data": zstandard.ZstdCompressionDict(trained)}
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        reader = zstandard.ZstdDecompressor(**options).decompressobj()
        parts, step = [], 1 << 16
        while not reader.eof:
            if at >= len(archive):
                raise ValueError("an archive ends within a record")
            parts.append(reader.decompress(archive[at : at + step]))
            at += min(step, len(archive) - at)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields and payload of a record; raises where header and lengths disagree."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("a record without the end of its header")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0].encode("ascii") != VERSION:
        raise ValueError(f"unknown version {lines[0]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record without {name}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        raise ValueError("a length that is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header's")
    block = rest[:length]
    if fields.get("warc-block-digest") not in (None, f"sha1:{payload_digest(block)}"):
        raise ValueError("a block's digest differs from its header's")
    http, found, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
    if not found or not http.startswith(b"HTTP/") or not said:
        raise ValueError("a block that is no HTTP message")
    kind = fields["warc-type"]
    if kind == "response":
        if int(said[1]) != len(payload):
            raise ValueError("a payload's length differs from its header's")
        if fields["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
            raise ValueError("a payload's digest differs from its header's")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"a record of kind {kind!r} that can't be read")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(said[1]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to", "")),
        "payload": payload if kind == "response" else None,
    }


def _page(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri)
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below the folder (``RECORD_SCHEMA``).

    Revisits have no payload, but its length and digest. Dictionary, frames,
    headers, lengths and digests are checked, and what does not agree is an error.
    """
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.rpartition(",")[0]
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for frame in frames(memoryview(archive.as_buffer())):
                    row = parse_record(frame)
                    rows.append({name: row[name] for name in names})
                    size += len(frame) if payloads else ROW_OVERHEAD
                    if size >= 4 * ROW_BYTES:
                        yield _batch(rows, names, types)
                        rows, size = [], 0
                yield _batch(rows, names, types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(read, schema)


def _batch(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    arrays = [pa.array([row[name] for row in rows], kind) for name, kind in zip(names, types)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def checked_revisits(records: DataFrame) -> DataFrame:
    """Records with ``resolved``: whether a revisit's length and digest are those of the
    response that it names (true for responses)."""
    answers = (
        records.filter((F.col("record_type") == "response") & F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(
            F.collect_set(F.struct("payload_bytes", "payload_digest")).alias("_answers"),
        )
        .withColumnRenamed("page_id", "refers_to")
    )
    own: Column = F.struct("payload_bytes", "payload_digest")
    found = F.coalesce(F.array_contains("_answers", own), F.lit(False))
    return records.join(answers, "refers_to", "left").select(
        *records.columns, ((F.col("record_type") == "response") | found).alias("resolved")
    )
