"""Incremental ingest and downstream upkeep as availableNow streams.

A run processes what arrived since the last one (the checkpoint remembers) and
stops. Micro-batches are written to a folder of their own, overwritten when a
batch is retried, so a lost executor or a restarted run leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from docengine.schemas import FILES


def _bounded(reader: DataStreamReader, max_files: int | None) -> DataStreamReader:
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Unseen files of a folder as a stream of path, times, length and content.

    ``max_files`` bounds a micro-batch, so that a first run over a large folder
    is written (and can be resumed) in parts.
    """
    return (
        _bounded(spark.readStream.format("binaryFile"), max_files)
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def stream_rows(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    name_glob: str,
    max_files: int | None = None,
) -> DataFrame:
    """Unseen parquet files of a folder as a stream of rows."""
    reader = _bounded(spark.readStream, max_files)
    return reader.schema(schema).option("pathGlobFilter", name_glob).parquet(folder)


def stream_table(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Unseen files of a parquet table, which is a folder of files or a single file."""
    # As a pattern: of a plain path Spark expects that it is a folder.
    place, _, name = path.rstrip("/").rpartition("/")
    return _bounded(spark.readStream, max_files).schema(schema).parquet(f"{place}/{{{name}}}")


def ingest_stream(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Transform unseen input and append it to ``target``, once each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """All ingested rows, without the batch number."""
    return spark.read.schema(schema).parquet(target).drop("batch_id")


def upsert_stream(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Keep a keyed table in step with a stream of changed rows.

    Each micro-batch only appends its rows; ``current_rows`` resolves them. The
    cost of a run is that of its changes, however large the table has become.
    """
    return ingest_stream(stream, transform, target, checkpoint)


def with_tombstones(rows: DataFrame, brought: DataFrame, owner: str) -> DataFrame:
    """Rows of a micro-batch, and for each owner that it brought (a file, say) a row
    that holds nothing else: it ends the owner's earlier rows even where no new row
    takes their place."""
    return rows.unionByName(brought.select(owner).distinct(), allowMissingColumns=True)


def current_rows(
    spark: SparkSession,
    target: str,
    schema: StructType,
    key: str = "uuid",
    owner: str | None = None,
) -> DataFrame:
    """The rows that hold now.

    With ``owner``, the rows of each owner's latest batch: what a file no longer has
    goes with its earlier batches, and only owners and batch numbers are grouped.
    Rows without a key are tombstones. Without it, the latest row per key.
    """
    with_batch = StructType([*schema.fields, StructField("batch_id", LongType())])
    logged = spark.read.schema(with_batch).parquet(target)
    if owner:
        latest = logged.groupBy(owner).agg(F.max("batch_id").alias("batch_id"))
        held = logged.filter(F.col(key).isNotNull()).join(latest, [owner, "batch_id"])
        return held.select(*schema.fieldNames())
    columns = [name for name in logged.columns if name not in (key, "batch_id")]
    return (
        logged.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.col("batch_id")).alias("row"))
        .select(key, "row.*")
    )


def compact(
    spark: SparkSession,
    target: str,
    schema: StructType,
    into: str,
    key: str = "uuid",
    owner: str | None = None,
) -> None:
    """Write the current rows as batch 0 of a new folder, to read from later on."""
    current_rows(spark, target, schema, key, owner).write.mode("overwrite").parquet(f"{into}/batch_id=0")
