"""File scans. Listing is distributed and never reads file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import base_name, file_extension


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file below ``folder``: path, times, length and content.

    Spark skips names that begin with ``_`` or ``.``. Columns that are not used
    downstream are pruned, so a listing does not open the files.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )


def list_files(files: DataFrame) -> DataFrame:
    """Paths with their names: ``file_name`` is the lower-cased matching key."""
    name = base_name(F.col("path"))
    return files.select(
        F.lower(name).alias("file_name"),
        F.col("path").alias("full_path"),
        file_extension(name).alias("file_extension"),
    )
