"""From documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written and read again as the next one's documents.
All but the last return the columns of the documents that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import written
from docengine.llm.langid import UNDETERMINED, fit_bound, learn, predict
from docengine.llm.mixing import mixed
from docengine.llm.ngram_join import without_near_duplicates
from docengine.llm.packing import pack
from docengine.llm.secret_scan import new_ledger, redacted, scan_history

# Of two and more languages, the best must be likelier than all others together.
LEAST_SCORE = 0.5
# What a text of n letters may fall below the bound on its fit: few letters say little.
MARGIN = 20.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Those without letters (null and
    empty texts among them) go, and those that look like none of the learned languages:
    whose letters are less probable than a bound from the labelled documents, in the best
    of them. Repeated rows share their fate; without a labelled row no document stays."""
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    model = learn(docs.select("text", "lang"), F.lit(True), pieces)
    # Written: all fits give the bound that each is then held against.
    found = written(predict(docs.select("text", row), model, pieces, fit=True), "fits", of_texts=True)
    bound = fit_bound(found, F.col("row.`lang`"))
    like = F.col("fit") >= F.lit(bound) - MARGIN / F.col("letters")
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE) & like
    of = {c: F.col(f"row.`{c}`").alias(c) for c in rest} | {"text": F.col("text")}
    return found.filter(kept).select(*[of[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; texts without
    words (null and empty ones) all stay."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a sign and ``n_chars`` counted anew; texts
    without one, null texts among them, stay as they are, row by row."""
    versions = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("content"))
    found = scan_history(versions, new_ledger(spark))
    hit = F.size("spans") > 0
    text = redacted(F.col("row.text"), F.col("spans"))
    changed = {
        "text": F.when(hit, text).otherwise(F.col("row.text")),
        "n_chars": F.when(hit, F.length(text).cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, some not at all, shuffled in shards. Texts
    without words are drawn like others of their source; null is a source of its own."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    return mixed(rows).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and places; null texts are empty,
    an end sign alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

# Tokenizers and MinHash have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
