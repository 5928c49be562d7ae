"""Inputs that Spark derives from the given tables, always from all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.chunking import chunk_documents, sequential_chunks
from docengine.operators.ingest import ingest_documents
from docengine.operators.keys import parted
from docengine.session import materialise, spread

ELEMENT = "\n"  # the documents part their elements by single line breaks
FILE_BYTES = 64 << 20  # bytes of text in a file that streams in


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def document_path(extension: Column) -> Column:
    return F.concat(
        F.lit("/vol/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), extension
    )


def lines() -> Column:
    return F.split("text", "\n")


def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as PDF files whose pages are their lines."""
    return documents(spark, folder).select(
        document_path(F.lit(".pdf")).alias("path"), lines().alias("pages")
    )


def bronze(spark: SparkSession, folder: str) -> DataFrame:
    return ingest_documents(extracted_pages(spark, folder))


def gold_sequential(spark: SparkSession, folder: str) -> DataFrame:
    chunks = sequential_chunks(F.col("text"), element_regex=ELEMENT)
    return chunk_documents(bronze(spark, folder), chunks)


def dated_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of several types whose first page may hold a date.

    The date is that of the order with the document's number; the order's
    priority decides how it is written. French files of one source could not be read.
    """
    day = F.date_format("o_orderdate", "d MMMM yyyy")
    month = F.date_format("o_orderdate", "MMMM yyyy")
    first = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Publication date: "), day))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Report published in "), month))
        .when(F.col("o_orderpriority") == "3-MEDIUM", day)
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("defining a may 12345"))
        .when(F.col("o_orderstatus") == "F", F.lit("no date here"))
        .otherwise(F.concat(F.lit("Published on\n"), month))
    )
    extension = (
        F.when(F.col("lang") == "en", ".pdf")
        .when(F.col("lang") == "fr", ".PDF")
        .when(F.col("lang") == "de", ".tar.gz")
        .otherwise("")
    )
    damaged = (F.col("lang") == "fr") & (F.col("source") == "src7")
    joined = documents(spark, folder).join(
        table(spark, folder, "orders").select(
            "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
        ),
        F.col("doc_id") == F.col("o_orderkey"),
        "left",
    )
    return joined.select(
        "doc_id",
        document_path(extension).alias("path"),
        F.coalesce(first, F.lit("")).alias("first_page"),
        F.when(~damaged, F.array_prepend(lines(), F.coalesce(first, F.lit("")))).alias("pages"),
        F.when(damaged, F.lit("page tree is damaged")).alias("error"),
    )


def old_and_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: the old one without toxic documents, the new one without
    low-quality ones and with French texts edited."""
    labels = (
        table(spark, folder, "labels")
        .groupBy("doc_id")
        .agg(*[
            F.max(F.coalesce(test, F.lit(False))).alias(name)
            for name, test in (("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0))
        ])
    )
    flagged = materialise(labels.filter("toxic OR poor"), "flagged")
    may, clean = parted(table(spark, folder, "documents"), flagged, "doc_id")
    none = F.lit(None).cast("boolean")
    # Texts meet the labels once, whatever the snapshots are used for.
    docs = materialise(
        may.join(flagged, "doc_id", "left").unionByName(clean.withColumns({"toxic": none, "poor": none})).select(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("uuid"),
            "lang",
            F.col("text").alias("content"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
            F.coalesce("poor", F.lit(False)).alias("poor"),
        ),
        "labelled",
    )
    edited = F.when(F.col("lang") == "fr", F.concat(F.lit("Version deux. "), F.col("content")))
    old = docs.filter(~F.col("toxic")).select("uuid", "content")
    new = docs.filter(~F.col("poor")).select(
        "uuid", F.coalesce(edited, F.col("content")).alias("content")
    )
    return old, new


def label_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question vector per label: the mean of its vectors."""
    return (
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("placed"))
        .select(
            F.col("label").alias("question_id"),
            F.transform("placed", lambda each: each["x"]).alias("embedding"),
        )
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("topic")
    )


def long_form() -> Column:
    return F.initcap("p_name")


def short_form() -> Column:
    words = F.split("p_name", " ")
    return F.upper(F.array_join(F.transform(words, lambda word: F.substring(word, 1, 1)), ""))


def glossary_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model responses about parts; the part type decides their form: lists,
    lone objects, unreadable certainties, broken text and none at all."""
    item = F.format_string(
        '{"acronym": "%s", "definition": "%s", "certainty": %d}',
        short_form(), long_form(), F.col("p_size") + 50,
    )
    brand = F.format_string(
        '{"acronym": "BR", "definition": "%s", "certainty": %d}', F.col("p_brand"), F.col("p_size")
    )
    vague = F.format_string(
        '[{"acronym": "%s", "definition": "%s", "certainty": "high"}]', short_form(), long_form()
    )
    response = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("["), item, F.lit("]")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("["), item, F.lit(", "), brand, F.lit("]")))
        .when(F.col("p_type") == "SMALL", item)
        .when(F.col("p_type") == "LARGE", vague)
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("Sure, here it is: "), item))
    )
    return table(spark, folder, "part").select(
        F.format_string("part_%d.pdf", F.col("p_partkey")).alias("file_name"),
        response.alias("glossary_json"),
    )


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup terms: padded acronyms, wildcard patterns from nation names, misses."""
    padded = table(spark, folder, "part").select(
        F.concat(F.lit(" "), F.lower(short_form()), F.lit(" ")).alias("term")
    )
    nations = table(spark, folder, "nation")
    starts = nations.select(F.concat(F.substring("n_name", 1, 1), F.lit("%")).alias("term"))
    ends = nations.select(F.concat(F.lit("_"), F.substring("n_name", 2, 1)).alias("term"))
    misses = table(spark, folder, "region").select(F.col("r_name").alias("term"))
    return padded.union(starts).union(ends).union(misses).distinct()


def chunk_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model-suggested chunks as JSON: in single quotes for French documents,
    with a sentence before them (so unreadable) for Spanish ones."""
    listed = F.to_json(
        F.transform(
            lines(), lambda line, i: F.struct((i + 1).alias("chunk_number"), line.alias("content"))
        )
    )
    response = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("'"), listed, F.lit("'")))
        .when(F.col("lang") == "es", F.concat(F.lit("Here are the chunks: "), listed))
        .otherwise(listed)
    )
    return documents(spark, folder).select("doc_id", "text", response.alias("response"))


def partial_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model-suggested chunks, in German without the first line, in French with the last
    one twice and a line that is nowhere."""
    of = (
        F.when(F.col("lang") == "de", F.slice("lines", 2, F.size("lines")))
        .when(F.col("lang") == "fr", F.concat("lines", F.slice("lines", -1, 1), F.array(F.lit("Nulle part; \u2620"))))
        .otherwise(F.col("lines"))
    )
    numbered = F.transform(
        of, lambda line, i: F.struct((i + 1).alias("chunk_number"), line.alias("content"))
    )
    return documents(spark, folder).withColumn("lines", lines()).select(
        "doc_id", "text", F.to_json(numbered).alias("response")
    )


def tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations in which long answers are tool calls and later user turns
    hold the results."""
    call_id = lambda turn: F.format_string("call_%d_%d", F.col("conv_id"), turn)
    call = F.struct(
        call_id(F.col("turn")).alias("id"),
        F.lit("lookup_glossary").alias("name"),
        F.create_map(F.lit("input_acronym"), F.substring("text", 1, 3)).alias("arguments"),
    )
    calls = (F.col("role") == "assistant") & (F.length("text") > 150)
    result = (F.col("role") == "user") & (F.col("turn") > 1)
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.when(result, "tool").otherwise("text").alias("kind"),
        F.when(result, call_id(F.col("turn") - 1)).alias("call_id"),
        F.when(calls, F.array(call)).alias("tool_calls"),
    )


def recorded_tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written down as recorded calls (user turns) and results."""
    body = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    name = lambda turn: F.format_string("call_%d", turn)
    call = F.concat(
        F.lit("Let me see.\n<uc_function_call>"),
        body(
            id=name(F.col("turn")), name=F.lit("search_documentation"),
            arguments=body(topic=F.col("text")),
        ),
        F.lit("</uc_function_call>"),
    )
    result = F.concat(
        F.lit("<uc_function_result>"),
        body(id=name(F.col("turn") - 1), content=F.col("text")),
        F.lit("</uc_function_result>\nDone."),
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "user", call)
        .when(F.col("role") == "assistant", result)
        .otherwise(F.col("text"))
        .alias("text"),
    )
