"""Token counts with a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import shared_folder, written
from docengine.llm.tokenization import encoder, file_digest

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def empty_cache(spark: SparkSession) -> str:
    """A new cache folder below the shared folder, without counts."""
    folder = shared_folder(spark, "token-counts")
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(folder)
    return folder


def token_counts(
    documents: DataFrame, tokenizer: str, cache: str, limit: int = 512
) -> DataFrame:
    """Token counts of whole texts: ``doc_id, n_bytes, n_tokens, over_limit``.

    The text (null: empty) is normalised to its UTF-8 bytes, which is all that a
    count depends on, and named by their SHA-256. Together with the digest of
    the tokenizer's file the name is looked up in ``cache`` (a Parquet folder of
    ``CACHE_SCHEMA``); only distinct contents that are not there are encoded,
    and their counts are appended. A second run over the same texts encodes
    nothing. Appends of two jobs at once may repeat an entry, never change it.

    One row per input row: repeated rows and equal texts get equal counts, null
    ids are kept, the empty text has 0 tokens, an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    version = file_digest(tokenizer)
    content = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    named = documents.select("doc_id", content.alias("text"), digest.alias("digest"))
    keys = named.select(
        "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")
    )
    stored = (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache)
        .filter(F.col("tokenizer") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    # At most one copy of a text per task is sent on, so no copy is hot.
    misses = (
        named.select("digest", "text")
        .mapInArrow(_first_of_each, "digest binary, text string")
        .repartition("digest")
        .join(stored.select("digest").hint("shuffle_hash"), "digest", "left_anti")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in _first_of_each(batches):
            sizes = [len(encode(text)) // 4 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest"),
                    pa.array([version] * len(sizes), pa.string()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["digest", "tokenizer", "n_tokens"],
            )

    counted = written(misses.mapInArrow(count, CACHE_SCHEMA), "new-counts")
    known = stored.unionByName(counted.select("digest", "n_tokens"))
    result = written(
        keys.join(known, "digest", "left").select(
            "doc_id",
            "n_bytes",
            "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
        ),
        "token-counts",
    )
    counted.write.mode("append").parquet(cache)
    return result


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop rows whose digest this task has already passed on."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for key in batch.column("digest").to_pylist():
            fresh.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(fresh, pa.bool_()))
