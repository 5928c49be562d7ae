"""Evaluation inputs and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluation_source(bronze: DataFrame, n: int = 20, key: str = "file_name") -> DataFrame:
    """The first ``n`` documents by key, as ``doc_uri`` and ``content``; equal keys by
    path, where there is one."""
    order = [key] + [name for name in ("path",) if name in bronze.columns]
    return (
        bronze.orderBy(*order)
        .limit(n)
        .withColumnsRenamed({"text": "content", "file_name": "doc_uri"})
    )


def evaluation_records(messages: DataFrame) -> DataFrame:
    """``{request: {messages}, expected_response}`` per row of a message history."""
    return messages.select(
        "conv_id",
        "turn",
        F.struct(F.col("messages")).alias("request"),
        F.lit(None).cast("string").alias("expected_response"),
    )


def retrieval_metrics(
    results: DataFrame,
    relevant: DataFrame,
    k: int,
    question: str = "question_id",
    key: str = "uuid",
) -> DataFrame:
    """Recall@k, precision@k and reciprocal rank per question that has relevant keys.

    The results are the small side: an inner join lets Spark broadcast them when
    they are, which a semi join against the relevant rows would not.
    """
    hits = (
        relevant.select(question, key)
        .join(results.filter(F.col("rank") <= k).select(question, key, "rank"), [question, key])
        .distinct()
        .groupBy(question)
        .agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_hit"))
    )
    totals = (
        relevant.select(question, key)
        .distinct()
        .groupBy(question)
        .agg(F.count(F.lit(1)).alias("relevant"))
    )
    found = F.coalesce(F.col("hits"), F.lit(0))
    return totals.join(hits, question, "left").select(
        question,
        "relevant",
        found.alias("hits"),
        (found / F.col("relevant")).alias("recall"),
        (found / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Means over questions."""
    return metrics.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("precision"), 6).alias("mean_precision"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
    )
