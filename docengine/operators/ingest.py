"""From files to bronze rows, and which files are still to be read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import (
    base_name,
    clean_text,
    extract_year,
    file_extension,
    join_parts,
    strip,
    text_length,
)
from docengine.schemas import BRONZE

# Extension that is read, and the texts of placeholder rows.
SUPPORTED = (".pdf",)
UNSUPPORTED_TEXT = "Unsupported file type: "
ERROR_TEXT = "Error processing file: "


def extract_pages(files: DataFrame, extractor) -> DataFrame:
    """Apply a caller's extractor to file contents on the executors.

    ``extractor`` maps the ``path`` and ``content`` columns to a
    ``struct<pages: array<string>, text: string, error: string>``; a pandas UDF
    fits. It reports failures in ``error`` instead of raising.
    """
    read = files.select("path", extractor(F.col("path"), F.col("content")).alias("read"))
    return read.select("path", "read.pages", "read.text", "read.error")


EXTRACTED = "path string, pages array<string>, text string, error string"


def extract_files(files: DataFrame, extractor: Callable[[str, bytes], Iterable[dict]]) -> DataFrame:
    """Rows of ``EXTRACTED`` from files (``path, content``), on the executors, batch or stream.

    ``extractor`` takes a path and the bytes of one file and gives one dictionary per
    document in it: ``path`` (default that of the file), ``pages``, ``text``, ``error``. What it
    raises becomes an error row of that file, behind the documents that it gave before;
    the other files are not touched by it. Rows leave as they are made: a container of
    very many documents is never held whole as rows.
    """
    names = [field.split(" ")[0] for field in EXTRACTED.split(", ")]
    kinds = pa.schema([("path", pa.string()), ("pages", pa.list_(pa.string())), ("text", pa.string()), ("error", pa.string())])

    def documents_of(path: str, content: bytes) -> Iterator[dict]:
        try:
            for found in extractor(path, content):
                yield {"path": path, **found}
        except Exception as failure:  # a damaged file is a row, not a failed job
            yield {"path": path, "error": f"{type(failure).__name__}: {failure}"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = documents_of(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())
                while some := list(islice(found, 512)):
                    rows = [{name: each.get(name) for name in names} for each in some]
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(task, EXTRACTED)


def ingest_documents(
    extracted: DataFrame, clean: bool = True, supported: tuple[str, ...] = SUPPORTED
) -> DataFrame:
    """Bronze rows from ``(path, pages, [text], [error])``, one per file.

    The year comes from the first page, else from all pages. ``clean`` joins
    lines before matching (batch ingest); without it pages are only stripped
    (incremental ingest). Unsupported and failed files stay as rows whose text
    is a message; ``status`` tells them apart.
    """
    name = base_name(F.col("path"))
    pages = F.col("pages")
    given = F.col("text") if "text" in extracted.columns else F.lit(None).cast("string")
    error = F.col("error") if "error" in extracted.columns else F.lit(None).cast("string")
    prepare = clean_text if clean else strip

    failure = F.coalesce(
        error, F.when(pages.isNull() | (F.size(pages) == 0), F.lit("no pages"))
    )
    status = (
        F.when(~F.col("file_extension").isin(*supported), "unsupported")
        .when(failure.isNotNull(), "error")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    year = F.coalesce(
        extract_year(prepare(F.get(pages, F.lit(0)))),
        extract_year(prepare(join_parts(pages))),
    )
    text = (
        F.when(ok, F.coalesce(given, join_parts(pages)))
        .when(
            F.col("status") == "unsupported",
            F.concat(F.lit(UNSUPPORTED_TEXT), F.col("file_extension")),
        )
        .otherwise(F.concat(F.lit(ERROR_TEXT), failure))
    )
    return (
        extracted.withColumn("file_name", name)
        .withColumn("file_extension", file_extension(F.col("file_name")))
        .withColumn("status", status)
        .withColumn("bronze_text", text)
        .select(
            "path",
            "file_name",
            "file_extension",
            F.when(ok, F.size(pages)).cast("int").alias("num_pages"),
            F.when(F.col("status") == "error", F.lit(0).cast("bigint"))
            .otherwise(text_length(F.col("bronze_text")))
            .alias("length"),
            F.when(ok, year).alias("year"),
            F.col("bronze_text").alias("text"),
            "status",
        )
        .select(*BRONZE.fieldNames())
    )


def batch_counters(bronze: DataFrame) -> DataFrame:
    """Rows and characters per status; combined on the map side."""
    return bronze.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("characters")
    )


def new_files(listing: DataFrame, processed: DataFrame, key: str = "file_name") -> DataFrame:
    """Listed files whose name is not yet processed; both sides lower-cased.

    Names are made distinct first (combined before the shuffle), so that a base
    name shared by many processed files counts once and the join side is small.
    """
    seen = processed.select(F.lower(F.col(key)).alias("_seen")).distinct()
    return listing.join(seen, F.lower(F.col(key)) == F.col("_seen"), "left_anti")
