"""Session helpers: local sessions for tests, shared work folders, scan spreading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

TEXT_ROWS = 1000  # whole texts that Python is given at a time


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. Cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docengine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``.

    Only a local session that names no such folder falls back to the machine's
    temporary folder; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="docengine-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Batches of at most ``rows`` rows for Python meanwhile: a batch of whole texts is held
    by the JVM, outside its heap, and by the worker, in every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write a result to the shared work folder and read it back.

    For results that are used several times: they are computed once, and
    losing an executor costs no recomputation. ``batch_rows``: Python takes in rows of
    much data on the way, so many at a time.
    """
    folder = work_folder(df.sparkSession, label)
    with small_batches(df.sparkSession, batch_rows) if batch_rows else nullcontext():
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out a scan before per-row work such as chunking.

    The rebalance hint leaves the number and the size of partitions to adaptive
    execution, which also splits those that one key fills.
    """
    return df.hint("rebalance", *keys)
