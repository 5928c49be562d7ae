"""Token ids in binary files: an adaptive context-mixing range coder per block.

A file is a run of segments, a segment the ids of whole documents in ascending
order, cut into blocks. All numbers are little-endian:

    magic "TIB2" | u64 bytes that follow | u32 file | u32 segment in the file
    u32 documents | u32 blocks | u64 directory bytes | u32 directory checksum
    directory: zlib of a byte (has an id) and i64 (the id) and u64 (number of ids)
    u32 checksum of the table | table: u32 ids, u32 checksum of the ids, u32 bytes
    payloads of the blocks (see ``token_codec``) | line feed

Checksums are CRC-32. Files are written by Spark's committed writer in the order
of their numbers; a lost task leaves no half file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import parts_of, running_before, strings, written
from docengine.llm.token_codec import BLOCK, LANES, decode_blocks, encode_blocks
from docengine.llm.tokenization import encoder

MAGIC = b"TIB2"
HEAD = "<4sQ"
FIXED = "<IIIIQI"
DIRECTORY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("ids", "<u8")])
TABLE = np.dtype([("ids", "<u4"), ("check", "<u4"), ("bytes", "<u4")])
SEGMENT_IDS = BLOCK * LANES
TEXT_BYTES = 4 << 20  # of texts that are encoded at once
DIGEST_SCHEMA = (
    "file long, segment long, place long, doc_id long, within long, n_tokens long, "
    "ids_crc32 long"
)


def segment(file: int, number: int, documents: list[tuple], ids: bytes) -> bytes:
    """``documents``: (id or None, number of ids) in the order of ``ids``."""
    directory = np.array(
        [(doc_id is not None, doc_id or 0, n) for doc_id, n in documents], DIRECTORY
    )
    packed = zlib.compress(directory.tobytes(), 6)
    blocks = encode_blocks(np.frombuffer(ids, "<u4"))
    table = np.array([(n, check, len(body)) for n, check, body in blocks], TABLE).tobytes()
    body = b"".join(
        [
            struct.pack(FIXED, file, number, len(documents), len(blocks), len(packed), zlib.crc32(packed)),
            packed,
            struct.pack("<I", zlib.crc32(table)),
            table,
            *[body for _, _, body in blocks],
        ]
    )
    return struct.pack(HEAD, MAGIC, len(body)) + body


def segments(file: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(file, segment, directory, ids) of every segment; raises on damage."""
    at = 0
    while at < len(file):
        if len(file) - at < struct.calcsize(HEAD):
            raise ValueError("a file ends within a segment's header")
        magic, size = struct.unpack_from(HEAD, file, at)
        at += struct.calcsize(HEAD)
        if magic != MAGIC or at + size + 1 > len(file) or file[at + size] != 0x0A:
            raise ValueError("no segment, or one that was cut")
        number, segment_no, n_docs, n_blocks, packed, check = struct.unpack_from(FIXED, file, at)
        at += struct.calcsize(FIXED)
        directory = file[at : at + packed]
        if zlib.crc32(directory) != check:
            raise ValueError("a directory's checksum does not agree")
        directory = np.frombuffer(zlib.decompress(directory), DIRECTORY)
        at += packed
        (check,) = struct.unpack_from("<I", file, at)
        raw = file[at + 4 : at + 4 + n_blocks * TABLE.itemsize]
        if zlib.crc32(raw) != check or len(directory) != n_docs:
            raise ValueError("a block table's checksum does not agree")
        table = np.frombuffer(raw, TABLE)
        at += 4 + len(raw)
        blocks = []
        for n, block_check, length in table.tolist():
            blocks.append((n, block_check, file[at : at + length]))
            at += length
        ids = decode_blocks(blocks)
        if len(ids) != int(directory["ids"].sum()):
            raise ValueError("ids and directory differ in number")
        yield number, segment_no, directory, ids
        at += 1


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Encode whole texts (null: empty), append ``end_id``, write the files.

    Ascending by id, null ids first; rows with the same id are ordered by a hash of
    their text, so that an id which very many rows share is spread over files too.
    An empty table writes no segment. Other columns are ignored.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids_of_all
        file = TaskContext.get().partitionId()
        number, waiting, ids, size = 0, [], [], 0

        def row() -> pa.RecordBatch:
            made = segment(file, number, waiting, b"".join(ids))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["part"])

        for batch in parts_of(batches, TEXT_BYTES):
            encoded, counts = encode(strings(batch.column("text")))
            ends = np.cumsum(counts)
            encoded = np.insert(encoded, ends, end_id)  # after each document
            ends += np.arange(1, len(ends) + 1)
            documents = list(zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist()))
            at = done = 0
            while at < len(documents):  # as many as the segment needs
                to = int(np.searchsorted(ends, done + SEGMENT_IDS - size)) + 1
                to = min(to, len(documents))
                waiting += documents[at:to]
                ids.append(encoded[done : ends[to - 1]].tobytes())
                size += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
                if size >= SEGMENT_IDS:
                    yield row()
                    number, waiting, ids, size = number + 1, [], [], 0
        if waiting:
            yield row()

    order = ["doc_id", "_tie"]
    rows = (
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie")
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    rows.mapInArrow(made, "part binary").select(F.col("part").cast("string")).write.text(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` is the number of ids of all documents before it. Every block is
    decoded and its checksum compared.
    """
    schema = DIGEST_SCHEMA + (", ids binary" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("content"):
                for number, segment_no, directory, ids in segments(file.as_py()):
                    yield digest(number, segment_no, directory, ids)

    def digest(number: int, segment_no: int, directory: np.ndarray, ids: np.ndarray):
        sizes = directory["ids"].astype(np.int64)
        ends = np.cumsum(sizes)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
        n = len(sizes)
        arrays = [
            pa.array(np.full(n, number), pa.int64()),
            pa.array(np.full(n, segment_no), pa.int64()),
            pa.array(np.arange(n), pa.int64()),
            pa.array(directory["doc_id"], pa.int64(), mask=directory["known"] == 0),
            pa.array(ends - sizes, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array([zlib.crc32(part) for part in parts], pa.int64()),
        ]
        if with_ids:
            arrays.append(pa.array([bytes(part) for part in parts], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    files = spark.read.format("binaryFile").load(folder)
    digests = written(files.select("content").mapInArrow(read, schema), "token-digests")
    per_segment = digests.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"))
    per_segment = running_before(per_segment, "n", "_in_file", ["file"], ["segment"])
    per_file = digests.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    per_file = running_before(per_file, "n", "_in_all", [], ["file"])
    before = written(
        per_segment.join(per_file.select("file", "_in_all"), "file").select(
            "file", "segment", (F.col("_in_file") + F.col("_in_all")).alias("_before")
        ),
        "segment-starts",
    )
    return digests.join(before, ["file", "segment"]).select(
        "doc_id",
        (F.col("_before") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
