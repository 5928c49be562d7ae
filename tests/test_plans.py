"""Physical plans: no cross joins, no row-at-a-time Python, narrow chunking."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from docengine import session
from docengine.plans.queries import QUERIES
from docengine.functions import text as tx
from docengine.operators import chunking, embedding, ingest, retrieval

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    found = plan(driver.queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", found)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize(
    "column",
    [
        chunking.recursive_chunks, chunking.sequential_chunks,
        lambda t: chunking.combine_elements(F.split(t, "\n"), 300),
        lambda t: chunking.combine_small_chunks(F.split(t, "\n"), 300),
        tx.clean_text, tx.extract_year, lambda t: tx.windows(t, 1000),
        lambda t: embedding.hashed_vector(tx.tokens(t)),
    ],
)
def test_text_work_is_narrow_and_stays_in_the_jvm(spark, column):
    found = plan(documents(spark).select("doc_id", column(F.col("text")).alias("made")))
    assert not re.search("Exchange|Python|Arrow", found)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in found


def test_chunks_are_computed_once(spark):
    rows = documents(spark).select(F.lit("f").alias("file_name"), "text")
    gold = chunking.chunk_documents(rows, chunking.recursive_chunks(F.col("text")))
    assert plan(embedding.embed(gold)).count("aggregate(transform(") == 1


def test_filters_reach_the_scan(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    asked = vectors.limit(3).select(F.col("vec_id").alias("question_id"), "embedding")
    found = plan(
        retrieval.nearest(asked, vectors, 2, key="vec_id", filters_json='{"label": [1, 2]}')
    )
    assert re.search(r"PushedFilters: \[In\(label, \[1,2\]\)\]", found)


def test_probed_cells_prune_folders(spark, tmp_path):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    index = embedding.write_cells(embedding.with_cell(vectors, 4, 64), str(tmp_path / "cells"))
    asked = vectors.limit(1).select(F.col("vec_id").alias("question_id"), "embedding")
    found = plan(retrieval.nearest_cells(asked, index, 2, planes=4, radius=1, key="vec_id"))
    assert re.search(r"PartitionFilters: \[cell#\d+ (IN|INSET)", found)


def test_texts_do_not_pass_through_the_scoring(spark):
    gold = documents(spark).select(
        F.concat(F.lit("d"), "doc_id").alias("uuid"), F.col("text").alias("content")
    )
    index = session.materialise(embedding.embed(gold), "index")
    asked = embedding.embed(documents(spark).limit(2).select(F.col("doc_id").alias("question_id"), "text"), "text")
    found = plan(retrieval.nearest(asked, index, 2))
    assert "MapInArrow" in found and "content" not in found


def test_new_files_is_an_anti_join(spark):
    left = spark.createDataFrame([("a",)], "file_name string")
    assert "LeftAnti" in plan(ingest.new_files(left, left))
