"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Iterable, Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.session import TEXT_ROWS as TEXT_ROWS
from docengine.session import small_batches, work_folder


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share (``spark.checkpoint.dir``)."""
    return work_folder(spark, label)


def written(df: DataFrame, label: str, of_texts: bool = False, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: later steps start from the files,
    so that neither a lost executor nor a second use computes the plan again.
    ``of_texts``: Python takes in whole texts on the way, in ``small_batches``.
    ``codec``: compression if not the session's own."""
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    with small_batches(spark) if of_texts else nullcontext():
        (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fresh(label: str) -> str:
    """A column name that no input has."""
    return f"_{label}_{uuid.uuid4().hex[:8]}"


def worker_state(use: str) -> dict:
    """What a Python worker keeps from task to task (tasks carry their own copy
    of this package, so its modules can't hold it). A worker serves the tasks of many
    stages: what it keeps for one use goes when another use begins."""
    name = "_docengine_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if kept.get("use") != use:
        kept["use"], kept["state"] = use, {}
        gc.collect()  # an encoder and its cache hold each other
    return kept["state"]


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [text or "" for text in column.to_pylist()]


def parts_of(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes (by their mean), a row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def running_before(
    rows: DataFrame, amount: str, before: str, group: list[str], order: list[str]
) -> DataFrame:
    """Sum of ``amount`` over the rows of the group that come earlier.

    For tables of counts per task or block, which are small; rows of documents
    never pass through this window.
    """
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(before, F.coalesce(F.sum(amount).over(window), F.lit(0)).cast("long"))


def text_key(text: Column) -> Column:
    """16 bytes that name a text; null and the empty text have different keys."""
    return F.when(text.isNull(), F.lit(b"null")).otherwise(F.unhex(F.md5(text.cast("binary"))))


def salted(key: Column, parts: int) -> Column:
    """A number below ``parts`` from a row's own values, the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(7919)), F.lit(parts)).cast("int")


def join_by_hot_key(
    rows: DataFrame, entries: DataFrame, key: str, count: str, most: int = 4096
) -> DataFrame:
    """Inner join of ``rows`` to ``entries``, which has each key once and how many rows have it.

    Keys of one in ``most`` rows or more, of which there can be no more than ``most``, are
    broadcast; the others are joined by a shuffle, where each fills a partition by no more
    than that share of all rows. ``entries`` should be a written table; no key is null.
    """
    total = entries.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * most >= total
    hot = entries.filter(is_hot)
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(
            rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
                entries.filter(~is_hot), key
            )
        )
    )


def left_join_by_hot_key(
    rows: DataFrame, entries: DataFrame, key: str, count: str, spread: Column, most: int = 4096
) -> DataFrame:
    """Left join of ``rows`` to ``entries``, in one pass over ``rows``; as ``join_by_hot_key``.

    ``key`` is a digest of 16 bytes, null in rows that meet nothing. Rows whose key is
    broadcast, and rows without a key, are dealt by ``spread`` in the shuffle for the others.
    """
    total = entries.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * most >= total
    values = [c for c in entries.columns if c != key]
    hot_key, hot_value, cold_key, cold_value = (fresh(c) for c in ("hk", "hv", "ck", "cv"))
    value = F.struct(*values)
    hot = entries.filter(is_hot).select(F.col(key).alias(hot_key), value.alias(hot_value))
    cold = entries.filter(~is_hot).select(F.col(key).alias(cold_key), value.alias(cold_value))
    # 17 bytes, so that they equal no digest.
    elsewhere = F.concat(F.lit(b"-"), F.unhex(F.md5(spread.cast("string"))))
    waits = F.col(hot_value).isNull() & F.col(key).isNotNull()
    met = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left").join(
        cold, F.when(waits, F.col(key)).otherwise(elsewhere) == F.col(cold_key), "left"
    )
    found = F.coalesce(hot_value, cold_value)
    return met.select(*rows.columns, *[found[c].alias(c) for c in values])
