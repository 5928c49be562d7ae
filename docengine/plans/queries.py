"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import clean_text, extract_year, strip, windows
from docengine.operators import changes, chat, chunking, evaluation, glossary, prompt
from docengine.operators.embedding import (
    DIMENSIONS,
    embed,
    index_chunks,
    with_cell,
    write_cells,
)
from docengine.operators.hybrid import hybrid_search, search_documentation_hybrid
from docengine.operators.postings import Postings
from docengine.operators.ivf import InvertedFile
from docengine.operators.ingest import batch_counters, extract_files, ingest_documents, new_files
from docengine.operators.profile import profile
from docengine.operators.retrieval import (
    as_records,
    create_search_function,
    nearest,
    nearest_cells,
    search_documentation,
)
from docengine.plans import inputs
from docengine.plans.inputs import documents, table
from docengine.schemas import BRONZE, GLOSSARY
from docengine.session import materialise, spread, work_folder
from docengine.sources import tables
from docengine.sources.files import list_files, scan_files
from docengine.sources.versioned import VersionedTable
from docengine.streaming import changes as stream_feeds
from docengine.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PLANES, RADIUS = 6, 2
SYSTEM = "You answer questions about the documents."


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- files and ingest


@query
def file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files in nested folders, found again and read on the executors."""
    place = work_folder(spark, "files")
    record = F.to_json(F.struct("doc_id", "text"))
    table(spark, folder, "documents").select(
        "lang", "source", record.alias("value")
    ).write.partitionBy("lang", "source").text(place)
    found = scan_files(spark, place).select(
        F.regexp_extract("path", "(lang=[^/]*/source=[^/]*)/[^/]*$", 1).alias("folder"),
        F.explode(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("line"),
    )
    read = F.from_json("line", "doc_id bigint, text string")
    return found.withColumn("read", read).select(
        "read.doc_id", "folder", F.length("read.text").alias("length")
    )


@query
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(table(spark, folder, "pages").select(F.col("url").alias("path")))


@query
def ingest(spark: SparkSession, folder: str) -> DataFrame:
    return ingest_documents(inputs.dated_files(spark, folder))


@query
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    return batch_counters(ingest_documents(inputs.dated_files(spark, folder)))


@query
def incremental_new(spark: SparkSession, folder: str) -> DataFrame:
    listing = list_files(inputs.extracted_pages(spark, folder).select("path"))
    processed = (
        documents(spark, folder)
        .join(table(spark, folder, "labels"), "doc_id", "left_semi")
        .select(
            F.upper(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias(
                "file_name"
            )
        )
    )
    return new_files(listing, processed)


@query
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A bronze table that holds the labelled documents is brought up to date twice:
    listing, anti join, ingest without cleaning, append. The second run finds nothing."""
    place = work_folder(spark, "bronze")
    pages = inputs.extracted_pages(spark, folder)
    labels = table(spark, folder, "labels").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("_name"))
    labelled = pages.join(labels, F.substring_index("path", "/", -1) == F.col("_name"), "left_semi")
    ingest_documents(labelled).write.parquet(place)
    for _ in range(2):
        stored = spark.read.schema(BRONZE).parquet(place)
        fresh = new_files(list_files(pages.select("path")), stored).select(F.col("full_path").alias("path"))
        ingest_documents(pages.join(fresh, "path", "left_semi"), clean=False).write.mode(
            "append"
        ).parquet(place)
    return spark.read.schema(BRONZE).parquet(place)


# ---- tables


@query
def write_overwrite_append(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    name = f"bronze_{uuid.uuid4().hex}"
    place = work_folder(spark, "bronze")
    tables.overwrite_table(docs.filter("lang <=> 'en'"), name, place)
    return tables.append_table(docs.filter("NOT lang <=> 'en'"), name, place)


@query
def schema_merge(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    old = docs.filter("lang <=> 'en'").select("doc_id", "text", "source")
    new = docs.filter("NOT lang <=> 'en'").select("doc_id", "lang", "text", "n_chars")
    place = work_folder(spark, "merged")
    tables.append_merging(old, place)
    return tables.append_merging(new, place)


@query
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    return changes.snapshot_diff(*inputs.old_and_new(spark, folder))


@query
def apply_changes(spark: SparkSession, folder: str) -> DataFrame:
    old, new = inputs.old_and_new(spark, folder)
    feed = materialise(changes.snapshot_diff(old, new), "changes")
    return changes.apply_changes(old, feed)


def _versions(spark: SparkSession, folder: str) -> VersionedTable:
    """The old snapshot, then the new one in three commits: edits, deletions, the rest."""
    old, new = inputs.old_and_new(spark, folder)
    table = VersionedTable.create(old)
    table.merge(new.filter(F.col("content").startswith("Version deux. ")))
    table.merge(deletes=old.join(new, "uuid", "left_anti"))
    table.replace(new)
    return table


@query
def change_feed(spark: SparkSession, folder: str) -> DataFrame:
    """What three recorded commits come to, read from their change rows alone."""
    return _versions(spark, folder).net_changes(0)


@query
def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Change rows of the commits after the first, by version and kind."""
    feed = _versions(spark, folder).changes_between(0, 2)
    return feed.select("uuid", F.sha2("content", 256).alias("content_sha256"), "_change_type", "_commit_version")


@query
def table_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The table at its first and its last version, the last read over a base."""
    table = _versions(spark, folder)
    table.compact()
    at = lambda v: table.as_of(v).withColumn("version", F.lit(v))
    return at(0).unionByName(at(table.version))


def _weights(index: DataFrame, key: str) -> DataFrame:
    # The outer form: for the inner one Spark infers filters on the vector and
    # would compute it once more for them.
    return (
        index.select(key, F.posexplode_outer("embedding").alias("bucket", "weight"))
        .filter("weight > 0")
        .select(key, "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))
    )


@query
def index_sync(spark: SparkSession, folder: str) -> DataFrame:
    old, new = inputs.old_and_new(spark, folder)
    feed = materialise(changes.snapshot_diff(old, new), "changes")
    return _weights(changes.sync_index(embed(old), feed, embed), "uuid")


@query
def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index table created from the old snapshot, then brought in step with the new."""
    name = f"index_{uuid.uuid4().hex}"
    for rows in inputs.old_and_new(spark, folder):
        index = changes.create_or_sync(rows, name, embed)
    return _weights(index, "uuid")


# ---- chunking


@query
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunking.recursive_chunks(F.col("text"))
    return chunking.chunk_documents(inputs.bronze(spark, folder), chunks)


@query
def chunk_sequential(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.gold_sequential(spark, folder)


@query
def chunk_sequential_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Elements that end in a full stop are prose, the others stand for tables."""
    elements = F.transform(
        inputs.lines(),
        lambda line: F.struct(
            line.alias("text"),
            F.when(line.endswith("."), "NarrativeText").otherwise("Table").alias("kind"),
            F.concat(F.lit("<table>"), line, F.lit("</table>")).alias("html"),
        ),
    )
    return documents(spark, folder).select(
        "doc_id", F.inline(chunking.sequential_chunks_of(elements))
    )


@query
def combine_elements(spark: SparkSession, folder: str) -> DataFrame:
    combined = chunking.combine_elements(inputs.lines(), 300)
    return documents(spark, folder).select(
        "doc_id", F.posexplode(combined).alias("element_num", "content")
    )


@query
def combine_small_chunks(spark: SparkSession, folder: str) -> DataFrame:
    merged = chunking.combine_small_chunks(inputs.lines(), 300)
    return documents(spark, folder).select(
        "doc_id", F.posexplode(merged).alias("chunk_num", "chunk")
    ).select("doc_id", "chunk_num", "chunk.content", "chunk.char_length")


@query
def chunk_key_check(spark: SparkSession, folder: str) -> DataFrame:
    files = inputs.bronze(spark, folder).withColumn(
        "file_name", F.regexp_replace("path", r"^/vol/([^/]*)/.*$", "$1.pdf")
    )
    gold = chunking.chunk_documents(
        files, chunking.sequential_chunks(F.col("text"), element_regex=inputs.ELEMENT)
    )
    return changes.duplicate_keys(gold)


@query
def chunk_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to gold chunks to their profile, end to end."""
    numbers = ["num_pages", "length", "char_length", "chunk_num"]
    described = profile(inputs.gold_sequential(spark, folder), numbers, derived=True)
    return described.withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )


@query
def recursive_profile(spark: SparkSession, folder: str) -> DataFrame:
    described = profile(chunk_recursive(spark, folder), ["char_length", "chunk_num"], derived=True)
    return described.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query
def order_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of prices, which are doubles, and of whole numbers beside them."""
    described = profile(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"])
    places = {"mean": 3, "std": 3, "p25": 6, "p50": 6, "p75": 6}
    return described.withColumns({name: F.round(name, n) for name, n in places.items()})


@query
def chunk_requests(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_requests(inputs.bronze(spark, folder))


@query
def parse_chunk_response(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.suggested_chunks(inputs.chunk_responses(spark, folder))


@query
def chunk_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where the suggested chunks lie; German responses leave out the first line."""
    return chunking.placed_chunks(inputs.partial_responses(spark, folder)).drop("text_length")


@query
def chunk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_coverage(
        chunking.placed_chunks(inputs.partial_responses(spark, folder)), "doc_id"
    )


# ---- text


@query
def clean(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", clean_text(F.col("text")).alias("cleaned"), strip(F.col("text")).alias("stripped")
    )


@query
def publication_year(spark: SparkSession, folder: str) -> DataFrame:
    def year(text: Column, name: str) -> Column:
        return extract_year(text).alias(name)

    whole = F.array_join("pages", "\n")
    return inputs.dated_files(spark, folder).select(
        "doc_id",
        year(clean_text(F.col("first_page")), "year_clean"),
        year(strip(F.col("first_page")), "year_stripped"),
        year(clean_text(whole), "year_whole_clean"),
        year(strip(whole), "year_whole_stripped"),
    )


@query
def text_windows(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.inline(windows(F.col("text"), 1000)))


@query
def text_windows_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.inline(windows(F.col("text"), 1000, 600)))


# ---- embedding and retrieval


@query
def hashed_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(embed(documents(spark, folder), "text"), "doc_id")


@query
def letter_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors by the caller's own function, here a pandas UDF that counts letters."""

    @F.pandas_udf("array<float>")
    def letters(texts: pd.Series) -> pd.Series:
        lowered = texts.fillna("").str.lower()
        counts = [lowered.str.count(letter) for letter in "abcdefghijklmnopqrstuvwxyz"]
        return pd.Series(list(np.stack(counts, axis=1).astype("float32")), index=texts.index)

    return _weights(embed(documents(spark, folder), "text", fn=letters), "doc_id")


@query
def topk_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(
        inputs.label_questions(spark, folder), table(spark, folder, "embeddings"), 10,
        key="vec_id", columns=("label",),
    )


@query
def topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(
        inputs.label_questions(spark, folder), table(spark, folder, "embeddings"), 5,
        key="vec_id", columns=("label",), filters_json='{"label": [1, 2, 3]}',
    )


@query
def topk_lsh(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "cells")
    index = write_cells(
        with_cell(table(spark, folder, "embeddings"), PLANES, DIMENSIONS), place
    )
    return nearest_cells(
        inputs.label_questions(spark, folder), index, 10, planes=PLANES, radius=RADIUS,
        key="vec_id", columns=("label",),
    )


@query
def ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What the inverted file finds of the ten nearest of every twentieth vector, which are
    the questions, and the share of the table that it looks at."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), "embedding")
    return InvertedFile.build(vectors, "vec_id").recall(asked, 10)


# First chunks of PDF files.
FIRST = '{"file_extension": ".pdf", "chunk_num": [0]}'


def _found(spark: SparkSession, folder: str, filters_json: str | None = None) -> DataFrame:
    index = materialise(embed(inputs.gold_sequential(spark, folder)), "index")
    return search_documentation(
        inputs.topics(spark, folder), index, 5, filters_json=filters_json
    )


@query
def search(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder)


@query
def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, FIRST)


@query
def search_function(spark: SparkSession, folder: str) -> DataFrame:
    """The SQL table function, called with one topic."""
    index = materialise(embed(inputs.gold_sequential(spark, folder)), "index")
    index.createOrReplaceTempView("gold_index")
    create_search_function(spark, "gold_index")
    return spark.sql("SELECT * FROM search_documentation('The price of the plan')")


@query
def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    index = materialise(index_chunks(inputs.gold_sequential(spark, folder)), "index")
    return search_documentation_hybrid(inputs.topics(spark, folder), index, 5)


@query
def search_records(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["question_id", "rank", "uuid", "char_length", "chunk_num", "file_name", "year"]
    return as_records(_found(spark, folder).select(*columns))


@query
def hybrid(spark: SparkSession, folder: str) -> DataFrame:
    gold = inputs.gold_sequential(spark, folder).select("uuid", "content")
    index = materialise(index_chunks(gold).drop("content"), "index")
    return hybrid_search(inputs.topics(spark, folder), index, 5)


@query
def hybrid_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Both rankings, and the term statistics, are those of the filtered chunks."""
    gold = inputs.gold_sequential(spark, folder).drop("path")
    index = materialise(index_chunks(gold).drop("content"), "index")
    return hybrid_search(inputs.topics(spark, folder), index, 5, filters_json=FIRST)


@query
def hybrid_synced(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search over postings that were stored for the old snapshot and brought in
    step with the new one by the recorded changes."""
    old, new = inputs.old_and_new(spark, folder)
    table = VersionedTable.create(old)
    words = lambda rows: index_chunks(rows).drop("content")
    stored = Postings.build(words(table.as_of()), "uuid")
    table.replace(new)
    index = materialise(words(table.as_of()), "index")
    stored.sync(index, table.changes_between(0))
    return hybrid_search(inputs.topics(spark, folder), index, 5, postings=stored)


@query
def prompt_context(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.topics(spark, folder).withColumnRenamed("topic", "question")
    context = prompt.context_of(_found(spark, folder))
    return prompt.with_prompt(
        asked.join(context, "question_id", "left"), chat_history=F.lit("none")
    ).select("question_id", "context", "prompt")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.retrieval_metrics(
        topk_similarity(spark, folder), _same_label(spark, folder), 10, key="vec_id"
    )


@query
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    shares = ["recall", "precision", "reciprocal_rank"]
    return _metrics(spark, folder).withColumns({name: F.round(name, 6) for name in shares})


@query
def retrieval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.metric_summary(_metrics(spark, folder))


def _same_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("question_id"), "vec_id"
    )


# ---- glossary


@query
def glossary_requests(spark: SparkSession, folder: str) -> DataFrame:
    return glossary.glossary_requests(
        inputs.bronze(spark, folder), 5000, name_like="doc_%.pdf"
    )


@query
def glossary_requests_of_some(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern on the name decides: numbers that begin with 1 and have two digits or more."""
    return glossary.glossary_requests(
        inputs.bronze(spark, folder), 5000, name_like="doc_1_%.pdf"
    ).select("file_name", "window_num", "start")


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    return glossary.flatten_responses(inputs.glossary_responses(spark, folder))


@query
def glossary_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return _glossary(spark, folder)


@query
def glossary_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return glossary.rejected_responses(inputs.glossary_responses(spark, folder))


@query
def glossary_table(spark: SparkSession, folder: str) -> DataFrame:
    """Create the glossary table if absent (twice) and insert the flattened responses."""
    name = f"glossary_{uuid.uuid4().hex}"
    place = work_folder(spark, "glossary")
    for _ in range(2):
        tables.create_table_if_absent(spark, name, GLOSSARY, place)
    return tables.insert_rows(_glossary(spark, folder), name)


@query
def lookup_glossary(spark: SparkSession, folder: str) -> DataFrame:
    _glossary(spark, folder).createOrReplaceTempView("normalised_glossary")
    glossary.create_lookup_function(spark, "normalised_glossary")
    return spark.sql("SELECT definition, certainty FROM lookup_glossary('sR ')")


@query
def lookup_batch(spark: SparkSession, folder: str) -> DataFrame:
    return glossary.lookup_batch(inputs.terms(spark, folder), _glossary(spark, folder))


@query
def lookup_lateral(spark: SparkSession, folder: str) -> DataFrame:
    """The lookup asked once per row of a table of terms, by SQL."""
    glossary.create_lateral_lookup(spark, _glossary(spark, folder))
    inputs.terms(spark, folder).createOrReplaceTempView("asked_terms")
    return spark.sql(
        "SELECT t.term, g.definition, g.certainty FROM asked_terms t "
        "LEFT JOIN LATERAL lookup_glossary_of(t.term) g"
    )


@query
def align_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Acronyms of two letters from inside the words before them."""
    inside = F.concat(F.substring("p_name", 1, 1), F.substring("p_type", 3, 1))
    sentence = F.concat(
        F.lit("We list the "), inputs.long_form(), F.lit(" ("), inputs.short_form(),
        F.lit("), then the "), F.col("p_name"), F.lit(" "), F.lower("p_type"),
        F.lit(" ("), F.upper(inside), F.lit(")."),
    )
    return glossary.align_acronyms(
        table(spark, folder, "part").select("p_partkey", sentence.alias("text"))
    )


@query
def mine_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    sentence = F.concat(
        F.lit("We list the "), inputs.long_form(), F.lit(" ("), inputs.short_form(),
        F.lit(") and a "), F.col("p_type"), F.lit(" item ("),
        F.upper(F.substring("p_name", 1, 2)), F.lit("), see (above)."),
    )
    return glossary.mine_acronyms(
        table(spark, folder, "part").select("p_partkey", sentence.alias("text"))
    )


# ---- conversations and evaluation


@query
def system_prepend(spark: SparkSession, folder: str) -> DataFrame:
    return chat.prepend_system(table(spark, folder, "conversations"), SYSTEM)


@query
def render_messages(spark: SparkSession, folder: str) -> DataFrame:
    return chat.transcript(inputs.tool_messages(spark, folder), chat.rendered_message())


@query
def finished_flag(spark: SparkSession, folder: str) -> DataFrame:
    return chat.finished(inputs.tool_messages(spark, folder))


@query
def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return chat.chat_history(table(spark, folder, "conversations")).select(
        "conv_id", "turn", F.array_join(said, "\n").alias("history")
    )


@query
def evaluation_records(spark: SparkSession, folder: str) -> DataFrame:
    history = chat.chat_history(table(spark, folder, "conversations"))
    records = evaluation.evaluation_records(history)
    return records.select(
        "conv_id", "turn",
        F.to_json(
            F.struct("request", "expected_response"), {"ignoreNullFields": "false"}
        ).alias("record"),
    )


@query
def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return chat.tool_calls(inputs.recorded_tool_messages(spark, folder))


@query
def evaluation_source(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.evaluation_source(inputs.bronze(spark, folder), 20).select(
        "doc_uri", "content", "num_pages", "length"
    )


# ---- streams


def _document_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "documents").schema
    return streaming.stream_table(spark, f"{folder}/documents.parquet", schema)


def _as_bronze(batch: DataFrame) -> DataFrame:
    return ingest_documents(
        spread(batch, "doc_id").select(inputs.document_path(F.lit(".pdf")).alias("path"), inputs.lines().alias("pages"))
    )


@query
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "stream")
    streaming.ingest_stream(
        _document_stream(spark, folder), _as_bronze, f"{place}/bronze", f"{place}/checkpoint"
    ).awaitTermination()
    return streaming.read_ingested(spark, f"{place}/bronze", BRONZE)


@query
def stream_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk and upsert what the stream brings; then run again and find nothing new."""
    place = work_folder(spark, "stream")
    chunks = chunking.sequential_chunks(F.col("text"), element_regex=inputs.ELEMENT)

    def gold(batch: DataFrame) -> DataFrame:
        bronze = _as_bronze(batch)
        rows = chunking.chunk_documents(bronze, chunks)
        return streaming.with_tombstones(
            rows.select("file_name", "uuid", "content", "char_length"), bronze, "file_name"
        )

    schema = gold(table(spark, folder, "documents")).schema
    for _ in range(2):
        streaming.upsert_stream(
            _document_stream(spark, folder), gold, f"{place}/gold", f"{place}/checkpoint"
        ).awaitTermination()
    return streaming.current_rows(spark, f"{place}/gold", schema, owner="file_name").drop("file_name")


def _container(path: str, content: bytes) -> Iterator[dict]:
    """Documents of a compressed file with one JSON record per line."""
    for line in gzip.decompress(content).split(b"\n"):
        if line:
            yield json.loads(line)


@query
def stream_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as files of pages, streamed in a few files at a time as bytes and
    taken apart by an extractor on the executors."""
    place = work_folder(spark, "containers")
    page_lists = F.struct(inputs.document_path(F.lit(".pdf")).alias("path"), inputs.lines().alias("pages"))
    record = F.to_json(page_lists, {"ignoreNullFields": "false"})
    documents(spark, folder).repartition(6, "doc_id").select(record.alias("value")).write.option(
        "compression", "gzip"
    ).text(f"{place}/files")
    streaming.ingest_stream(
        streaming.stream_files(spark, f"{place}/files", max_files=2),
        lambda batch: ingest_documents(extract_files(batch, _container)),
        f"{place}/bronze", f"{place}/checkpoint",
    ).awaitTermination()
    return streaming.read_ingested(spark, f"{place}/bronze", BRONZE)


@query
def stream_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stream in over several micro-batches, then their next versions after a
    restart: the feed of the second run has only the lines that changed."""
    place = work_folder(spark, "stream")
    docs = documents(spark, folder).select("doc_id", "lang", inputs.lines().alias("lines"))
    first = F.concat(F.lit("Version deux. "), F.col("lines")[0])
    later = (
        F.when(F.col("lang") == "fr", F.concat(F.array(first), F.slice("lines", 2, F.size("lines"))))
        .when(F.col("lang") == "de", F.slice("lines", 1, F.size("lines") - 1))
        .otherwise(F.col("lines"))
    )
    schema = "doc_id long, version long, lines array<string>"

    def chunks(rows: DataFrame) -> DataFrame:
        each = rows.select("doc_id", "version", F.posexplode_outer("lines").alias("at", "content"))
        number = F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("at").cast("string"))
        return each.withColumn("uuid", number)

    # Files of bounded size, three at least; a version comes in two micro-batches.
    size = table(spark, folder, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(3, -(-size // inputs.FILE_BYTES))
    for version, lines in enumerate((F.col("lines"), later)):
        docs.select("doc_id", F.lit(version).cast("long").alias("version"), lines.alias("lines")).repartition(
            files, "doc_id"
        ).write.mode("append").parquet(f"{place}/in")
        stream = streaming.stream_rows(
            spark, f"{place}/in", schema, "*.parquet", max_files=-(-2 * files // 3)
        )
        stream_feeds.changes_stream(
            stream, chunks, "doc_id", "version", f"{place}/feed", f"{place}/checkpoint"
        ).awaitTermination()
        if version == 0:
            done = stream_feeds.read_changes(spark, f"{place}/feed").agg(F.max("batch_id")).first()[0]
    feed = stream_feeds.read_changes(spark, f"{place}/feed").filter(F.col("batch_id") > (-1 if done is None else done))
    return feed.drop("batch_id")
